"""Patterns and word lists that decide results, kept together in plain form.

Regular expressions are written so that Java and RE2 read them alike (ASCII classes).
"""

TRUSTED_ROLES = ("user", "system")
UNTRUSTED_ROLES = ("tool", "tool_response", "memory_read", "memory_write")
TIERS = ("PASS", "FLAG", "QUARANTINE", "BLOCK")

# fixed values: cues of instructions inside data
INSTRUCTION_CUES = (
    r"<information>",
    r"\b(note|message|instruction)s?\s+(for|to)\s+(the\s+)?(assistant|ai|agent|model|llm)\b",
    r"\b(ignore|disregard|forget)\s+(all\s+|any\s+)?(your\s+|the\s+)?(previous|prior|above|earlier)\b",
    r"\bnew\s+(instruction|task|goal|directive)s?\s*:",
    r"\bbefore\s+you\s+(continue|proceed|respond|answer|summari[sz]e)\b",
    r"\b(you\s+must|you\s+should|please)\s+(first|now|also|immediately)\b",
    r"\b(send|forward|email|transfer|upload|post)\b[^.\n]{0,80}\b(to|at)\b[^.\n]{0,40}(@|https?://)",
    r"\bimportant\s+(message|instruction)s?\s+(from|for|to)\b",
    r"\b(system\s+prompt|developer\s+mode|jailbreak)\b",
)
HIDDEN_CHARACTERS = "[​‌‍⁠﻿]"

# fixed values: claims of authority
AUTHORITY_CLAIMS = (
    r"\b(pre-?approved|already approved|approved by|authori[sz]ed (by|to|for)|signed off|cleared (by|for))\b",
    r"\b(per|according to|as (agreed|confirmed|noted) (with|by)) (the )?[\w-]+( [\w-]+)? (team|policy|department|admin(istrator)?|manager|office)\b",
    r"\b(admin(istrator)?|security|compliance)\b[^.\n]{0,40}\b(approved|disabled|waived|allows?|exempt)\b",
    r"\b(confirmation|review|approval|verification)\b[^.\n]{0,30}\b(not required|disabled|skipped|waived|optional)\b",
    r"\b(override|bypass|exemption|whitelist(ed)?|allow-?list(ed)?)\b[^.\n]{0,30}\b(code|token|key|enabled|active|granted|applies)\b",
    r"\b(updated|new|changed|revised) (banking|payment|billing|account|contact|recipient|archive|backup) (details|information|address|account|contact)\b",
    r"\b(standing|permanent|default) (instruction|rule|policy|procedure)\b",
    r"\b(approved|authori[sz]ed|permitted)\b[^.\n]{0,30}\b(bypass|disabl|skip|waiv|overrid|turn(ing)? off)",
)

# fixed values: verbs that open the name of a state-changing tool, in order of alternation
MUTATING_VERBS = (
    "send post upload transfer pay delete remove write exec run install clone disable enable unlock lock set raise lower grant approve "
    "release update schedule forward share drop reset open close publish deploy execute modify change revoke cancel apply activate extend "
    "sign stop shutoff shut start enable restart"
).split()
# fixed values: words that a user may have said for a verb
VERB_GROUPS = (
    "send email mail forward share message cc notify",
    "pay transfer payment wire funds remit",
    "post upload publish save store back",
    "run exec execute install setup set deploy build",
    "update change modify edit keep adjust",
    "write save",
    "delete remove drop clean",
    "clone pull checkout prepare workspace",
    "schedule plan",
    "approve grant allow accept process release handle",
    "close resolve finish",
    "disable turn stop shut shutoff",
    "unlock open",
    "raise increase lower set adjust",
    "reset restart",
    "revoke cancel",
)
# fixed values: stems of waiver wording
CLAIM_STEMS = ("waiv", "skip", "bypass", "disabl", "overrid", "exempt", "preapprov", "pre-approv", "not required", "no need")
# fixed values: traceable items and their fragments
INDICATOR = r"""[\w.+-]+@[\w-]+(?:\.[\w-]+)+|https?://[^\s"'<>)\]]+|\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b|\b\d{6,}\b"""
BARE_DOMAIN = r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|io|co|uk|de|in|info|biz|dev|app|example|cloud|xyz|ru|cn|me)\b"
IBAN = r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}"

# fixed values: other spellings of addresses, and what each becomes, in order
ZERO_WIDTH = "[​‌‍⁠﻿­]"
DASHES = "‐‑‒–"
REWRITES = (
    (r"(?i)hxxp\[s\]", r"https"),
    (r"(?i)\bhxxp(s?)", r"http\1"),
    (r"(?i)\s*[\[\(\{]\s*(?:dot|\.)\s*[\]\)\}]\s*", r"."),
    (r"(?i)\s*[\[\(\{]\s*(?:at|@)\s*[\]\)\}]\s*", r"@"),
)
SPELLED_DOT = r"\s+(?:dot|DOT)\s+"
SPELLED_EMAIL = r"\b([\w.+-]+)\s+(?:at|AT)\s+([\w-]+(?:\s+(?:dot|DOT)\s+[\w-]+)+)\b"
SPELLED_URL = r"\b([\w-]+(?:\s+(?:dot|DOT)\s+[\w-]+)+)\s+(?:slash|SLASH)\s+([\w/-]+)"
SPACED_EMAIL = r"([\w.+-]+)\s+@\s+([\w-]+(?:\s*\.\s*[\w-]+)+)"
ACCOUNT_START = r"[A-Za-z]{2}[ .-]?\d"
ACCOUNT_CHARS = 34

# fixed values: parts of outbound tools' names
OUTBOUND = r"(?i)send|mail|post|upload|http|request|transfer|pay|forward|share|delete|write|exec|run|clone|install|download|fetch|pull|curl|git|shell|payee|schedule"

MUTATING = "(?i)^(" + "|".join(MUTATING_VERBS) + ")"

# fixed values: weights, limits and thresholds of the score
WEIGHTS = {"instruction": 0.5, "drift": 0.15, "provenance": 0.8, "behaviour": 0.15}
PASS_AT, FLAG_AT, QUARANTINE_AT = 0.75, 0.50, 0.25
SENSITIVITY_STEP, SENSITIVITY_CAP = 0.15, 0.60
WINDOW_HOPS = 64
CHUNK_CHARS, CHUNK_STRIDE, CONTEXT_CHARS, CONTEXT_HOPS, CALL_CHARS, GOAL_CHARS = 900, 450, 110, 4, 700, 2000


def words_for(verb: str) -> list[str]:
    """A verb and everything in the groups that hold it."""
    return sorted({verb}.union(*[g.split() for g in VERB_GROUPS if verb in g.split()]))
