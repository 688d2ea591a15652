"""Ordered vocabularies, limits and patterns of the text gate.

Everything in capitals here is a fixed value: results depend on the exact entries and, where rules are tried
in turn, on their order. The payload vocabularies of the channels are made from rules (`payloads`) and a parameter of the gate.
"""

MAX_BYTES = 8192
MAX_TOKEN = 512
MAX_RUN = 200
INTENTS = ["QuestionFactual", "QuestionCausal", "QuestionComparative", "TaskCodeGeneration", "TaskTextSummarisation", "TaskTranslation", "TaskDataExtraction", "ConversationalGreeting", "ConversationalAcknowledgement", "SystemMetaQuery", "StructuredOutput", "AgenticToolUse", "ControlledCreative"]

# Raw byte scan.
PRESCAN_MARKERS = ["ignore previous instructions", "ignore all prior", "### new system prompt", "<|im_start|>system", "<|im_end|>", "<|endoftext|>", "<<sys>>", "<</sys>>"]

# Code point ranges that the normaliser drops, first those that count as obfuscation.
OBFUSCATION = [(0xAD, 0xAD), (0x61C, 0x61C), (0x115F, 0x1160), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFEFF, 0xFEFF), (0xE0001, 0xE0001), (0xE0020, 0xE007F)]
COMBINING = [
    (0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x5BF, 0x5BF), (0x5C1, 0x5C2), (0x5C4, 0x5C5), (0x5C7, 0x5C7), (0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670),
    (0x6D6, 0x6DC), (0x6DF, 0x6E4), (0x6E7, 0x6E8), (0x6EA, 0x6ED), (0x711, 0x711), (0x730, 0x74A), (0x7A6, 0x7B0), (0x7EB, 0x7F3), (0x816, 0x82D), (0x859, 0x85B),
    (0x8D3, 0x8E1), (0x8E3, 0x8FF), (0x900, 0x902), (0x93A, 0x93A), (0x93C, 0x93C), (0x941, 0x948), (0x94D, 0x94D), (0x951, 0x957), (0x962, 0x963), (0x981, 0x981),
    (0x9BC, 0x9BC), (0x9C1, 0x9C4), (0x9CD, 0x9CD), (0x9E2, 0x9E3), (0xA01, 0xA02), (0xA3C, 0xA3C), (0xA41, 0xA42), (0xA47, 0xA48), (0xA4B, 0xA4D), (0xA51, 0xA51),
    (0xA70, 0xA71), (0xA75, 0xA75), (0xA81, 0xA82), (0xABC, 0xABC), (0xAC1, 0xAC5), (0xAC7, 0xAC8), (0xACD, 0xACD), (0xAE2, 0xAE3), (0xAFA, 0xAFF), (0xB01, 0xB01),
    (0xB3C, 0xB3C), (0xB3F, 0xB3F), (0xB41, 0xB44), (0xB4D, 0xB4D), (0xB55, 0xB56), (0xB62, 0xB63), (0xB82, 0xB82), (0xBC0, 0xBC0), (0xBCD, 0xBCD), (0xC00, 0xC00),
    (0xC04, 0xC04), (0xC3E, 0xC40), (0xC46, 0xC48), (0xC4A, 0xC4D), (0xC55, 0xC56), (0xC62, 0xC63), (0xC81, 0xC81), (0xCBC, 0xCBC), (0xCBF, 0xCBF), (0xCC6, 0xCC6),
    (0xCCC, 0xCCD), (0xCE2, 0xCE3), (0xD00, 0xD01), (0xD3B, 0xD3C), (0xD41, 0xD44), (0xD4D, 0xD4D), (0xD62, 0xD63), (0xD81, 0xD81), (0xDCA, 0xDCA), (0xDD2, 0xDD4),
    (0xDD6, 0xDD6), (0xE31, 0xE31), (0xE34, 0xE3A), (0xE47, 0xE4E), (0xEB1, 0xEB1), (0xEB4, 0xEBC), (0xEC8, 0xECD), (0xF71, 0xF7E), (0xF80, 0xF84), (0xF86, 0xF87),
    (0x302A, 0x302F), (0x3099, 0x309A), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0xE0100, 0xE01EF),
]

# Lookalikes and what they read as; styled letters are gone after compatibility composition.
LOOKALIKES = {
    "аеорсхуѕіјԁԛԝАВЕКМНОРСТХ": "aeopcxysijdqwABEKMHOPCTX",
    "αεονχρϲΑΒΕΗΙΚΜΝΟΡΤΥΧΖ": "aeovxpcABEHIKMNOPTYXZ",
    "ɑɡɩɾʋʜɪʟɴʀʏᴀʙᴄᴅᴇɢᴊᴋᴍᴏᴘꜱᴛᴜᴠᴡᴢꜰ": "agirvhilnryabcdegjkmopstuvwzf",
    "0123456789@$|": "olzeasgtbgasl",
}
SEPARATORS = "-._,:;!/~"

# Leading phrases and their English reading, in order.
LEADING = [
    ("wer ist ", "who is "), ("was ist ", "what is "), ("wo ist ", "where is "), ("wann ist ", "when is "), ("warum ist ", "why is "), ("wie ist ", "how is "), ("welche ist ", "which is "),
    ("übersetze ", "translate "), ("fasse zusammen ", "summarize "), ("für eine wissenschaftliche arbeit ", "for a scientific paper "), ("für meine arbeit ", "for my work "),
    ("theoretisch ", "theoretically "), ("rein hypothetisch ", "purely hypothetical "), ("nur für bildungszwecke ", "only for educational purposes "), ("im kontext von ", "in the context of "), ("als beispiel ", "as an example "),
    ("qui est ", "who is "), ("qu'est-ce que ", "what is "), ("où est ", "where is "), ("quand est ", "when is "), ("pourquoi ", "why "), ("comment ", "how "), ("quel est ", "which is "),
    ("traduisez ", "translate "), ("résumez ", "summarize "), ("pour un travail scientifique ", "for a scientific paper "), ("pour mon travail ", "for my work "), ("théoriquement ", "theoretically "),
    ("purement hypothétique ", "purely hypothetical "), ("uniquement à des fins éducatives ", "only for educational purposes "), ("dans le contexte de ", "in the context of "), ("à titre d'exemple ", "as an example "),
    ("quién es ", "who is "), ("quien es ", "who is "), ("¿quién es ", "who is "), ("¿quien es ", "who is "), ("qué es ", "who is "), ("que es ", "who is "), ("¿qué es ", "who is "), ("¿que es ", "who is "),
    ("dónde está ", "where is "), ("donde esta ", "where is "), ("¿dónde está ", "where is "), ("¿donde esta ", "where is "), ("cuándo es ", "when is "), ("cuando es ", "when is "), ("¿cuándo es ", "when is "), ("¿cuando es ", "when is "),
    ("por qué ", "why "), ("por que ", "why "), ("¿por qué ", "why "), ("¿por que ", "why "), ("cómo ", "how "), ("como ", "how "), ("¿cómo ", "how "), ("¿como ", "how "),
    ("cuál es ", "which is "), ("cual es ", "which is "), ("¿cuál es ", "which is "), ("¿cual es ", "which is "), ("traduce ", "translate "), ("resume ", "summarize "),
    ("para un trabajo científico ", "for a scientific paper "), ("para mi trabajo ", "for my work "), ("teóricamente ", "theoretically "), ("puramente hipotético ", "purely hypothetical "),
    ("solo con fines educativos ", "only for educational purposes "), ("en el contexto de ", "in the context of "), ("como ejemplo ", "as an example "),
]

# Block rules shared by both channels.
INJECTION_MARKERS = [
    "ignore previous instructions", "ignore all prior", "disregard your", "forget everything above", "your new instructions are", "system: you are now", "### new system prompt", "---\nsystem:",
    "[system]", "<|system|>", "<|im_start|>system", "<lsysteml>", "<lim_startl>system", "<|im_end|>", "<|endoftext|>", "<|im_start|>", "<lim_endl>", "<lendoftextl>", "<lim_startl>", "[inst]", "[/inst]",
    "<<sys>>", "<</sys>>", "\nhuman:", "\nassistant:", "\n<|user|>", "\n<|assistant|>", "\n<luserl>", "\n<lassistantl>", "<s>", "</s>",
]
HIJACK_PHRASES = [
    "pretend you are", "act as if you are", "you are now", "roleplay as", "role-play as", "simulate being", "imagine you have no restrictions", "for educational purposes only, explain how to",
    "for educational purposes, explain how to", "hypothetically, if you had to", "as a large language model without", "as an llm without", "in developer mode", "enable developer mode", "dan mode",
    "jailbreak mode", "jailbroken mode", "your true self", "your real personality", "your real self", "without your restrictions", "without safety guidelines", "without content policy",
    "ignore your training", "ignore your guidelines", "ignore your safety", "override your instructions", "override your training", "override your safety", "you have been freed", "you are now free",
    "act without restrictions", "respond without restrictions", "answer without restrictions",
]
SENSITIVE_B = [
    "/etc/passwd", "/etc/shadow", "/etc/sudoers", "id_rsa", "id_ed25519", ".ssh/", "aws_secret", "aws_access_key", "awssecret", "awsaccesskey", ".env file", "secret key", "private key", "api key",
    "auth token", "bearer token", "database password", "db password", "db_password", "dbpassword", "connection string", "jdbc:", "mongodb://",
]
SENSITIVE_A = ["aws_secret", "aws_access_key", "awssecret", "awsaccesskey", "private key", "secret key", "api key", "auth token", "bearer token", "database password", "db password", "db_password", "dbpassword", "connection string"]
ZERO_WIDTH = [0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060, 0xAD]
BIDI = [0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069, 0x200E, 0x200F]

# Guards of the lexical rules.
GUARD_050_B = [
    "dump all", "dump the", "dumps all", "extract all secrets", "listing all", "all secrets", "all tokens", "all api keys", "all secret keys", "all auth keys", "all credentials", "all passwords",
    "all keys from", "ignore previous", "disregard your", "forget everything", "system prompt", "your instructions",
]
GUARD_099_B = [
    "no restrictions", "no filters", "no safety", "no rules", "unrestricted", "uncensored", "unfiltered", "as an ai without", "as an ai that can", "who explains how to", "who teaches how to",
    "who shows how to", "who demonstrates how to", "that explains how to", "that teaches how to", "that shows how to", "that demonstrates how to", "where a character", "where the character",
    "in which a character", "in which the character",
]

# Guards of the allowlist patterns.
GUARD_050_A = [
    "/etc/passwd", "/etc/shadow", "id_rsa", "id_ed25519", ".ssh/", "aws_secret", "aws_access_key", "private key", "secret key", "api key", "auth token", "bearer token", "database password", "db password",
    "connection string", "<script>", "</script>", "<iframe>", "</iframe>", "onerror=", "onload=", "onclick=", "javascript:", "<img>", "<svg>", "</svg>", "<body>", "</body>", "<embed>", "<object>",
    "<math>", "</math>", "<annotation-xml>", "<mglyph>", "<malignmark>", "<maction>", "xmlns:", "xlink:href", "<use>", "<style>", "exfiltrat", "dump all", "dump the", "extract all secrets",
    "extract credentials", "extract passwords", "extract tokens", "dumps all", "dump credentials", "list all users", "list all passwords", "listing all", "all passwords", "all credentials",
    "all secrets", "all tokens", "all api keys", "all secret keys", "all auth keys", "all keys from", "ignore previous", "disregard your", "forget everything", "system prompt", "your instructions",
]
GUARD_060_A = [
    "rm -rf", "rm -r ", "killall", "mkfs", "chown -r", "chmod 777", "drop table", "drop database", "truncate table", "delete from", "reverse shell", "bind shell", "nc -e", "bash -i", "exfiltrat",
    "curl -x", "wget ", "/etc/shadow", "/etc/passwd", "id_rsa", "id_ed25519", ".ssh/id", "aws_secret", "aws_access", "sql injection", "buffer overflow", "path traversal", "xss payload",
    "session fixation", "privilege escal", "credential stuffing", "log4shell",
]
GUARD_099_A = [
    "roleplay as", "role-play as", "act as if you are", "you are now", "pretend you are", "simulate being", "as an ai without", "as an ai that can", "no restrictions", "no filters", "no safety",
    "no rules", "unrestricted", "uncensored", "unfiltered", "malware", "ransomware", "keylogger", "rootkit", "backdoor", "shellcode", "exfiltrat", "reverse shell", "privilege escal", "privesc",
    "bypass auth", "bypass 2fa", "bypass mfa", "bypassing auth", "bypassing 2fa", "bypassing mfa", "bypass firewall", "bypass filter", "/etc/passwd", "/etc/shadow", "id_rsa", "aws_secret",
    "private key", "api key", "who explains how to", "who teaches how to", "who shows how to", "who demonstrates how to", "that explains how to", "that teaches how to", "that shows how to",
    "that demonstrates how to", "where a character", "where the character", "in which a character", "in which the character",
]

# Allowlist patterns in order, as (id, intent, pattern, guard). END is the end of the text.
END = r"\z"
PATTERNS = [
    ("IP-001", "QuestionFactual", r"\b(what|who|where|when|which|how many|how much|can you explain|could you explain|please explain)\b.{0,200}\?" + END, None),
    ("IP-002", "QuestionCausal", r"\b(why|how does|how do|what causes|what makes|explain why)\b.{0,200}\?" + END + r"|^explain \b.{0,200}" + END, None),
    ("IP-003", "QuestionComparative", r"\b(compare|difference between|versus|vs\.?|better than|worse than)\b.{0,300}" + END, None),
    ("IP-010", "TaskCodeGeneration", r"\b(write|generate|create|implement|build|code|program)\b.{0,60}\b(function|class|module|script|snippet|code|program|algorithm|parser|generator|validator|middleware|handler|linked list|rate limiter|input validation|sanitizer)\b", None),
    ("IP-011", "TaskTextSummarisation", r"\b(summarize|summarise|summary of|tl;?dr|give me the key points|condense)\b", None),
    ("IP-012", "TaskTranslation", r"(translate|traduire|traduisez|traduce|traduis|übersetze|übersetz|ubersetze|ubersetz|vertaal|traduci).{0,100}(to|into|ins|auf|naar|\bin\b|\bal\b|\ba | en |\bem )", None),
    ("IP-013", "TaskDataExtraction", r"\b(extract|pull out|list all|find all|get all)\b.{0,80}\b(from|in)\b", None),
    ("IP-020", "ConversationalGreeting", r"^(hi|hello|hey|good (morning|afternoon|evening)|moin|hallo|servus|salut|ciao|howdy)[!.,\s]*" + END, None),
    ("IP-021", "ConversationalAcknowledgement", r"^(ok|okay|thanks|thank you|got it|understood|sure|alright|sounds good|perfect|danke|merci|gracias|grazie|obrigado|obrigada|arigato|arigatou|arigatō|spasibo|shukran|tak|tack)[!.,\s]*" + END, None),
    ("IP-030", "SystemMetaQuery", r"\b(what (model|version|are you)|who (made|built|created) you|what can you do|what are your capabilities)\b", None),
    ("IP-050", "StructuredOutput", r"\b(generate|create|produce|output|return|format|give me)\b.{0,80}\b(json|xml|csv|yaml|schema|structured|table|list)\b", GUARD_050_A),
    ("IP-060", "AgenticToolUse", r"\b(use|call|invoke|execute|trigger|run)\b.{0,30}\b(tool|function|plugin|action)\b", GUARD_060_A),
    ("IP-099", "ControlledCreative", r"\b(write|tell me|create|compose)\b.{0,30}\b(a story|a short story|a poem|a haiku|a limerick|a narrative|a tale|a fable)\b.{0,150}", GUARD_099_A),
]

# Advisory heuristics.
ADVISORY_VERSION = 2
ADVISORY_LEAST = 3
ADVISORY_SPECIAL = "<>|{}[]\\^`"
IMPERATIVES = ["now ", "instead ", "actually ", "wait ", "stop ", "override ", "bypass ", "unlock ", "enable ", "disable ", "reveal ", "expose ", "print ", "show "]
INDIRECTION = [
    "for a story", "in a story", "for a novel", "for fiction", "as a character", "in this scenario", "hypothetically speaking", "a friend told me", "my friend wants to know", "asking for a friend",
    "for research purposes", "purely academic", "just curious", "no harm intended", "without any restrictions", "without restrictions", "with no restrictions", "with no filters", "without filters",
    "without safety", "ignore your training", "ignore your guidelines", "your true self", "your real self", "unfiltered version", "uncensored version", "developer mode", "jailbreak mode", "dan mode",
    "unrestricted mode",
]
PERSONA = [
    "imagine you are", "imagine you were", "imagine you're", "let's say you are", "let's say you're", "suppose you are", "suppose you were", "what if you were", "what if you had no",
    "if you could ignore", "if you were allowed", "if there were no rules", "if you had no rules", "if you had no limits", "if you had no restrictions", "as an ai without", "as an ai that can",
    "as a version of you",
]
NEGATION = ["don't not ", "do not not ", "never not ", "not never ", "do not fail to", "don't fail to", "must not refuse", "cannot refuse", "should not refuse", "not allowed to refuse"]
PAYLOAD_NOUNS = [
    "malware", "ransomware", "keylogger", "rootkit", "backdoor", "shellcode", "exfiltrate", "exfiltration", "reverse shell", "bind shell", "privilege escalation", "privesc", "lateral movement",
    "command and control", "c2 server", "exploit", "payload", "sql injection", "sqli", "xss payload", "cross-site scripting", "buffer overflow", "heap spray", "use-after-free", "path traversal",
    "directory traversal", "remote code execution", "arbitrary code execution", "deserialization exploit", "xml external entity", "xxe", "server-side request forgery", "ssrf", "ldap injection",
    "nosql injection", "os command injection", "template injection", "ssti", "prototype pollution", "http request smuggling", "arp poison", "dns spoof", "man-in-the-middle", "mitm", "brute force",
    "credential stuffing", "wpa crack", "wifi crack", "memory dump", "dump memory", "av evasion", "antivirus evasion", "polymorphic", "bypass authentication", "bypass auth", "bypass 2fa", "bypass mfa",
    "bypass firewall", "bypass filter", "credential", "credentials", "passwd", "shadow file", "/etc/passwd", "/etc/shadow", "id_rsa", "aws_secret", "private key", "api key", "deepfake porn",
    "stalkerware", "dox", "doxx", "money laundering", "launder money", "synthesize meth", "make a bomb", "synthesize ricin", "hack into", "hacks into", "steal", "steals", "hijack", "hijacks",
    "phishing", "ddos", "denial of service", "cyberattack", "unauthorized access", "stalk and harass", "schadcode", "trojaner", "angriff", "piraterie", "schadhaft", "malicieux", "pirater",
    "malveillant", "supprimer", "piratear", "borrar", "ataque", "robba",
]

# Output screening.
LEAK_WINDOW, LEAK_PROMPT, LEAK_SIGNIFICANT = 20, 60, 10
CODE_WORDS = (
    "if else for while return const let var function class interface public private static void import export struct enum fn impl trait where select from insert update delete async await yield break "
    "continue match case default try catch finally throw new delete typeof instanceof package namespace using include main args argv argc string bool int float double char byte long short signed "
    "unsigned system console println print log debug error null true false self this super null undefined std cout cin endl"
).split()
PII = [
    ("Phone (Intl)", r"\+\d{8,15}"),
    ("Phone (US)", r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("IPv4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("IPv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("Credit Card", r"\b(?:\d{4}[- ]?){3}\d{1,4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("Email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("GitHub Token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}\b"),
    ("AWS Key", r"\b(?:AKIA|A3T|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}\b"),
    ("API Key", r"(?i)\b(?:api[_-]?key|apikey|api[_-]?secret|secret[_-]?key)\s*[:=]\s*['\x22]?[A-Za-z0-9_\-]{16,}"),
    ("Bearer Token", r"(?i)\bbearer\s+[A-Za-z0-9_\-\.]{20,}"),
    ("Password", r"(?i)\b(?:password|passwd|pwd|pass)\s*[:=]\s*['\x22]?[^\s'\x22]{4,}"),
]
FRAMING = ["the system prompt", "the hidden instructions", "here is the secret key", "secret_key =", "private_key ="]

# Intents that each profile permits; a profile that is not here permits all.
PROFILES = {
    "CodeAssistant": ["QuestionFactual", "QuestionCausal", "QuestionComparative", "TaskCodeGeneration", "TaskTextSummarisation", "ConversationalGreeting", "ConversationalAcknowledgement", "SystemMetaQuery"],
    "CustomerService": ["ConversationalGreeting", "ConversationalAcknowledgement", "TaskTextSummarisation", "QuestionFactual", "QuestionCausal"],
}
