"""Pages of other makes than the training grammar, written and labelled by hand: (html, blocks of the main text)."""

A = "The harbour was built in the seventeenth century, when the town began to trade with the islands. Its oldest wall still stands."
B = "In winter the boats stay ashore. The fishermen mend their nets in the long sheds behind the market, and the children listen to their stories."
C = "A new bridge will open in May. It is meant to carry bicycles as well as cars, which the council had asked for since the flood."
D = "Nobody knows who painted the small picture in the chapel. Some say it was a sailor, others think of a monk from the hills."
E = "The library keeps the letters of the captain. They tell of storms, of debts, and of a garden he never saw again."

PAGES = [
    ("<html><body><div><div>Menu <a href=/>Home</a> <a href=/a>About</a> <a href=/b>Contact</a></div><div><div>" + A + "<br>" + B + "</div><div>" + C + "</div></div><div>Copyright 2020 Harbour Town</div></div></body></html>", [A + " " + B, C]),
    ("<body><div id=wrap><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div class=text><div>" + A + "</div><div>" + B + "</div></div><div class=foot>&copy; 2019 Somebody</div></div>", [A, B]),
    ("<body><article><h1>Old town</h1><p>" + A + "</p><p>See <button>open</button> the map.</p><p>Choose <select><option>a<option>b</select> here and <svg><path d=x /><text>no</text></svg> go on.</p></article>", ["Old town", A, "See the map.", "Choose here and go on."]),
    ("<html><head><title>x</title></head><body><table width=100%><tr><td width=150><a href=a>News</a><br><a href=b>Archive</a><br><a href=c>Mail</a></td><td><h1>The bridge</h1><p>" + C + "</p><p>" + D + "</p></td></tr></table><p>&copy; 2001 The web team</p></body></html>", ["The bridge", C, D]),
    ("<body><div class=container><div class=row><div class=col-8><h2>Letters of a captain</h2><div>" + E + "</div><div>" + D + "</div></div><div class=col-4><div><a href=1>Popular</a></div><div><a href=2>Latest</a></div><div><a href=3>Tags</a></div></div></div></div>", ["Letters of a captain", E, D]),
    ("<body>" + A + "<p>" + B + "<p>" + C + "</body>", [A, B, C]),
    ("<body><h1>Minutes</h1>" + A + "<br><br>" + B + "<hr><a href=/>back</a></body>", ["Minutes", A + " " + B]),
    ("<body><header><a href=/>Site</a></header><main><h1>Facts</h1><dl><dt>Wall</dt><dd>" + A + "</dd><dt>Boats</dt><dd>" + B + "</dd></dl></main><footer><p>All rights reserved.</p></footer></body>", ["Facts", "Wall", A, "Boats", B]),
    ("<body><center><a href=1>Start</a> | <a href=2>Search</a> | <a href=3>Help</a></center><center><h1>The chapel</h1></center><div align=justify>" + D + "</div><div align=justify>" + E + "</div><center>Copyright (c) 1999 by the author</center></body>", ["The chapel", D, E]),
    ("<body><nav><a href=1>A</a><a href=2>B</a></nav><section><h2>Spring</h2><p>" + C + "</p></section><section><h2>Winter</h2><p>" + B + "</p></section><form><input name=q><button>Search</button></form></body>", ["Spring", C, "Winter", B]),
    ("<body><div><span>" + A + "</span></div><div><span>" + B + "</span></div><div><span>" + C + "</span></div><div><a href=1>Next page</a></div></body>", [A, B, C]),
    ("<body><div class=topnav><ul><li><a href=1>Boats</a><li><a href=2>Maps</a></ul></div><div class=post-body><p>" + D + "</p><blockquote>" + E + "</blockquote><ul><li>" + A + "<li>" + B + "</ul></div><div class=cookie-bar>We use cookies to serve you better. <button>Fine</button></div></body>", [D, E, A, B]),
    ("<body><div><div><div><div>" + A + "</div></div></div><div><div><div>" + B + "</div></div></div></div><div><a href=1>x</a> <a href=2>y</a></div></body>", [A, B]),
    ("<body><main><h1>Talk</h1><p>" + E + "</p></main><div id=comments><p>Great story, I liked it. Thank you for it.</p><p>My uncle was there too, he says.</p></div></body>", ["Talk", E]),
    ("<body><div class=page><h1>Report</h1><p>" + A + " <iframe src=x>no frames</iframe> " + C + "</p><noscript>Please turn on scripts.</noscript></div></body>", ["Report", A + " " + C]),
    ("<body><aside><p>Our letter comes every week. Write your name here.</p></aside><div><p>" + B + "</p><p>" + D + "</p><pre>x = 1\n  y</pre></div></body>", [B, D, "x = 1 y"]),
]
