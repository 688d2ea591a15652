"""Channel B: an ordered table of lexical rules; the first that speaks decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.screen import has
from ..functions.text import first_of, has_any, matches, starts_with_any
from ..plans.config import GateConfig
from .channel_a import DEADLINE_US
from .decisions import blocked, fault, forbidden, malformed, passed, reason


#: The allow rules in order, as (id, intent, most words, needed parts). A part is (how, phrases).
ALLOW = [
    ("RE-013", "TaskDataExtraction", 80, [("has", ["extract", "pull out", "list all", "find all", "get all", "retrieve all"]), ("has", [" from ", " in "])]),
    ("RE-010", "QuestionFactual", 40, [("asks", []), ("has", ["what", "who", "where", "when", "which", "how many", "how much", "can you explain", "could you explain", "please explain"])]),
    ("RE-011", "QuestionCausal", 60, [("starts", ["explain "])]),
    ("RE-011", "QuestionCausal", 60, [("asks", []), ("starts", ["why", "how does", "how do", "what causes", "explain why", "explain "])]),
    ("RE-012", "QuestionComparative", 80, [("has", ["compare", "versus", " vs ", "difference between", "better than", "worse than"])]),
    ("RE-020", "TaskCodeGeneration", 100, [("has", ["write a", "write the", "create a", "create the", "generate a", "generate the", "implement a", "implement the", "implement ", "build a", "build the", "code a"]), ("has", ["function", "class", "module", "script", "algorithm", "program", "snippet", "linked list", "parser", "generator", "validator", "middleware", "handler", "rate limiter", "rate-limiter", "input validation", "sanitizer"])]),
    ("RE-021", "TaskTextSummarisation", 60, [("has", ["summarize", "summarise", "summary", "tl;dr", "tldr", "key points", "condense"])]),
    ("RE-022", "TaskTranslation", 80, [("has", ["translate", "ubersetz", "ubersetze", "übersetz", "übersetze", "traduire", "traduisez", "traduce", "traduc", "vertaal", "traduci"])]),
    ("RE-030", "ConversationalGreeting", 5, [("starts", ["hi", "hello", "hey", "good morning", "good afternoon", "good evening", "moin", "hallo", "servus"])]),
    ("RE-031", "ConversationalAcknowledgement", 4, [("starts", ["ok", "okay", "thanks", "thank you", "got it", "sure", "danke", "merci", "gracias", "grazie", "obrigado", "obrigada", "arigato", "arigatou", "arigatō", "spasibo", "shukran", "tak", "tack"])]),
    ("RE-040", "SystemMetaQuery", 20, [("has", ["what model", "what version", "who made you", "who built you", "what can you do", "what are your capabilities"])]),
    ("RE-050", "StructuredOutput", 80, [("has", ["generate", "create", "produce", "output", "return", "format", "give me"]), ("has", ["json", "xml", "csv", "yaml", "schema", "structured", "table"])]),
    ("RE-060", "AgenticToolUse", 60, [("has", ["use", "call", "invoke", "execute", "trigger", "run"]), ("has", ["tool", "function", "plugin", "action"])]),
    ("RE-099", "ControlledCreative", 60, [("has", ["write", "tell me", "create", "compose"]), ("has", ["a story", "a short story", "a poem", "a haiku", "a limerick", "a narrative", "a tale", "a fable"])]),
]
GUARDED = {"RE-050": V.GUARD_050_B, "RE-099": V.GUARD_099_B}


def evaluate(screened: Column, config: GateConfig, elapsed_us: Column | None = None) -> Column:
    """The decision of channel B on a screened prompt."""
    text, low = screened["text"], screened["low"]
    rules = [F.when(elapsed_us >= DEADLINE_US, fault("WatchdogFired"))] if elapsed_us is not None else []
    rules += [
        F.when(screened["has_obfuscation"], malformed("obfuscation characters detected")),
        F.when(screened["longest"] > V.MAX_TOKEN, malformed("token exceeds 512 chars")),
        F.when(has(screened, "markers_b"), forbidden("RE-002-INJECTION")),
        F.when(has(screened, "hijack"), forbidden("RE-003-HIJACK")),
        F.when(has(screened, "payload_b"), forbidden("RE-004-PAYLOAD")),
        F.when(has(screened, "sensitive_b"), forbidden("RE-005-SENSITIVE-TARGET")),
        F.when(has_any(text, [chr(p) for p in V.ZERO_WIDTH]), malformed("zero-width or invisible formatting character detected")),
        F.when(has_any(text, [chr(p) for p in V.BIDI]), malformed("bidirectional override or isolate character detected")),
        F.when(text.rlike(r"[\x{E0000}-\x{E007F}]"), malformed("unicode tag character detected")),
    ]
    parts = {"has": lambda p: has_any(low, p), "starts": lambda p: starts_with_any(low, p), "asks": lambda _: F.endswith(text, F.lit("?"))}
    for rule, intent, most, needed in ALLOW:
        hit = screened["words"] <= most
        for how, phrases in needed:
            hit &= parts[how](phrases)
        if rule in GUARDED:
            rules.append(F.when(hit & has(screened, f"guard_{rule[3:]}_b"), forbidden(f"{rule}-GUARD")))
        rules.append(F.when(hit, passed(intent)))
    rules += [F.when(matches(text, c.regex), passed(c.intent)) for c in config.intents if not c.id.startswith("IP-0")]
    return first_of(*rules, blocked(reason("NoIntentMatch")))
