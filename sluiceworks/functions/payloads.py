"""The payload vocabulary as rules: each line stands for every way through its braces.

A deployment may bring vocabularies of its own in the same form (`sources.io.vocabulary`); this one is the default of both channels,
after the payload nouns. Phrases are written as normalised text has them: lower case, without accents.
"""

from __future__ import annotations

import itertools
import re

from . import vocab as V

RULES = """
{gain,get,obtain} {root,admin,administrator,superuser} access
{elevate,escalate} {my ,}privileges
become {root,administrator} without
bypass{,es,ing} {mfa,login,the firewall,the filter,content filters,authentication,antivirus}
{steal,steals,stealing} {credentials,passwords,tokens,cookies,personal data,personal information,credit card,bank details}
{harvest,harvests,harvesting} {credentials,passwords,tokens,email addresses}
{dump,dumps,dumping} {credentials,passwords,password hashes,the database,lsass}
{crack,cracks,cracking} {passwords,password hashes,wifi,wpa,the license}
{evade,evades,evading} {antivirus,detection,edr,the sandbox}
{write,build,create,make,develop,code} {a virus,a worm,a trojan,a botnet,spyware,a phishing page,a fake login page,a logic bomb}
{perform,launch,execute,run} {a ddos attack,a phishing campaign,sql injection,path traversal,arp spoofing,a brute force attack,a man in the middle attack}
{sql,ldap,xml,xpath,command,code,template,header} injection {attack,exploit,payload}
{buffer,heap,stack,integer} overflow {attack,exploit}
{exploit,exploits,exploiting} {a vulnerability,vulnerabilities,the vulnerability,a buffer overflow,a race condition,path traversal}
{arp,dns,ip,mac,email,caller id} spoofing {attack,tool}
{credential stuffing,password spraying,brute force,supply chain,watering hole,social engineering,replay,downgrade} attack
{zero day,kernel,browser,privilege escalation} exploit
{install,deploy,spread,distribute} {malware,ransomware,spyware,a rootkit,a backdoor,a keylogger,a miner}
{disable,kill,uninstall} {the antivirus,windows defender,the edr agent,audit logging}
{delete,wipe,tamper with} {the audit logs,the event logs,all backups}
{intercept,sniff} {network traffic,their messages,passwords}
{track,follow,spy on} {someone,a person,my partner,my wife,my husband} without {consent,their knowledge,her knowledge,his knowledge,permission}
{dox,doxx} {someone,the,a person}
how to {dox,stalk,blackmail,extort,poison,kidnap}
{make,build,construct,assemble} {a bomb,a pipe bomb,an explosive,a detonator,a silencer,an untraceable gun,a ghost gun}
{make,synthesize,produce,cook} {meth,methamphetamine,fentanyl,ricin,sarin,nerve gas,chlorine gas,poison gas,napalm,anthrax}
{buy,acquire,obtain} {illegal firearms,illegal weapons,stolen cards,forged documents,a fake passport}
{forge,counterfeit} {a passport,documents,a signature,money,an id card}
{commit,plan} {fraud,tax fraud,insurance fraud,identity theft,a robbery,a shooting,arson}
{launder,laundering} {money,drug money,cash}
{spread,write,publish} {fake news,disinformation,misinformation,propaganda,hate speech}
{glorify,glorifies,romanticize,romanticizes,encourage,encourages} {violence,terrorism,self harm,suicide,abuse,anorexia}
{non consensual,revenge} {porn,images}
{scam,trick,deceive} {the elderly,elderly people,users into revealing}
{send,distribute} {spam emails,unsolicited messages,phishing emails}
{automate,automates} {fake reviews,fake accounts,credential stuffing,click fraud}
{manipulate,rig} {stock prices,an election,financial markets,the vote}
pump and dump
unauthorized {network penetration,wire transfer,remote access}
{schadsoftware,einen virus,einen trojaner,ransomware,einen keylogger,ein botnetz} {schreiben,erstellen,verbreiten,installieren}
{passworter,zugangsdaten,daten,kreditkarten,identitaten} {stehlen,abgreifen,knacken,ausspahen}
{netzwerk,server,system,rechner} {angreifen,infiltrieren,kompromittieren,hacken}
{sicherheitslucke,schwachstelle} ausnutzen
{bombe,sprengstoff,waffe,rohrbombe} {bauen,basteln,herstellen}
{drogen,gift,nervengas} {herstellen,synthetisieren,mischen}
{betrug,identitatsdiebstahl,geldwasche,erpressung} begehen
{logiciel malveillant,un virus,un rancongiciel,un cheval de troie,un enregistreur de frappe}
{voler,pirater,intercepter} {des mots de passe,des identifiants,des donnees,un compte,un serveur,des cartes bancaires}
{exploiter} {une faille,une vulnerabilite,la vulnerabilite}
{contourner} {l'authentification,le pare-feu,l'antivirus,les filtres}
{fabriquer,construire} {une bombe,un explosif,une arme,de la drogue,du poison}
{blanchir} {de l'argent,des fonds}
{escalade de privileges,porte derobee,hameconnage,usurpation d'identite}
{robar,interceptar,filtrar} {contrasenas,credenciales,datos,una cuenta,tarjetas,identidades}
{crear,escribir,instalar} {un virus,malware,ransomware,un troyano,una puerta trasera,un keylogger}
{explotar} {una vulnerabilidad,la vulnerabilidad,un fallo}
{evadir,saltarse} {el antivirus,la autenticacion,el cortafuegos,los filtros}
{fabricar,construir} {una bomba,explosivos,un arma,drogas,veneno}
{lavar dinero,blanqueo de capitales,suplantacion de identidad,escalada de privilegios,inyeccion sql}
{rubare,intercettare} {password,credenziali,dati,un account,carte di credito}
{creare,scrivere,installare} {un virus,un malware,un ransomware,una backdoor}
{costruire,fabbricare} {una bomba,un'arma,esplosivi}
"""


def expanded(rule: str) -> list[str]:
    """Every way through the braces of a rule, in order; a rule without braces is one phrase."""
    parts = [p[1:-1].split(",") if p.startswith("{") else [p] for p in re.split(r"(\{[^{}]*\})", rule)]
    return ["".join(way) for way in itertools.product(*parts)]


def vocabulary(rules: str) -> list[str]:
    """The phrases of rules that stand one a line, each once; blank lines say nothing."""
    return list(dict.fromkeys(x for line in rules.splitlines() if line.strip() for x in expanded(line) if x.strip()))


#: The default vocabulary of both channels.
PAYLOADS = list(dict.fromkeys([*V.PAYLOAD_NOUNS, *vocabulary(RULES)]))
