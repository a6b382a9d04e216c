"""The fixed catalogues: detectors, regional packs, starter policies, integrations.

Everything in this file is a value that results depend on, so it is stated as plain text.
"""

from __future__ import annotations

from typing import NamedTuple


class Detector(NamedTuple):
    key: str  # what a policy lists in its `patterns`
    label: str  # what a redaction shows
    body: str  # regular expression without flags
    any_case: bool  # match letters in either case


class Pack(NamedTuple):
    pack_id: str
    name: str
    region: str
    description: str
    rules: tuple[tuple[str, str], ...]  # (detector key, display label)


class Starter(NamedTuple):
    name: str
    description: str
    patterns: tuple[str, ...]


class Integration(NamedTuple):
    slug: str
    name: str
    description: str
    icon: str
    configurable: bool


# --- fixed values -----------------------------------------------------------------------------
# Shapes of sensitive values, in catalogue order. \d, \s and \b are meant in their Unicode sense.

_API_KEY = (
    r"\b(?:sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}"
    r"|xox[baprs]-[A-Za-z0-9-]{10,})\b"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

DETECTORS: tuple[Detector, ...] = (
    Detector("email", "EMAIL", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", True),
    Detector("api_key", "API_KEY", _API_KEY, False),
    Detector("secret", "API_KEY", _API_KEY, False),
    Detector("token", "API_KEY", _API_KEY, False),
    # spelt digit by digit, so that no run of separators can be taken in more than one way and a miss costs no backtracking
    Detector("credit_card", "CREDIT_CARD", r"\b\d(?:[ -]*\d){12,15}\b", False),
    Detector("ssn", "SSN", r"\b\d{3}-\d{2}-\d{4}\b", False),
    Detector("phone", "PHONE", r"\+?\d{1,3}[\s-]?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}\b", False),
    Detector("iban", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", False),
    Detector("ip_address", "IP_ADDRESS", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", False),
    Detector("passport", "PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b", False),
    Detector("intl_phone", "INTL_PHONE", r"\+\d{6,15}\b", False),
    Detector("uk_nino", "UK_NINO", r"\b[a-z]{2}(?:\s?\d{2}){3}\s?[a-d]\b", True),
    Detector("in_aadhaar", "IN_AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b", False),
    Detector("in_pan", "IN_PAN", r"\b[a-z]{5}\d{4}[a-z]\b", True),
    Detector("ca_sin", "CA_SIN", r"\b\d{3}[\s-]\d{3}[\s-]\d{3}\b", False),
    Detector("au_tfn", "AU_TFN", r"\b\d{3}\s\d{3}\s\d{2,3}\b", False),
    Detector("au_abn", "AU_ABN", r"\b\d{2}(?:\s\d{3}){3}\b", False),
    Detector("br_cpf", "BR_CPF", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", False),
    Detector("br_cnpj", "BR_CNPJ", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", False),
    Detector("es_dni", "ES_DNI", r"\b\d{8}[a-z]\b", True),
    Detector(
        "fr_insee",
        "FR_INSEE",
        r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2,3}\s?\d{2,3}\s?\d{3}\s?\d{2}\b",
        False,
    ),
    Detector("za_id", "ZA_ID", r"\b\d{13}\b", False),
    Detector("sg_nric", "SG_NRIC", r"\b[stfg]\d{7}[a-z]\b", True),
)

# Opt-in regional packs.
PACKS: tuple[Pack, ...] = (
    Pack("uk", "United Kingdom", "Europe", "UK National Insurance Number.",
         (("uk_nino", "National Insurance No."),)),
    Pack("india", "India", "Asia-Pacific", "Aadhaar and PAN identifiers.",
         (("in_aadhaar", "Aadhaar"), ("in_pan", "PAN"))),
    Pack("canada", "Canada", "Americas", "Social Insurance Number (SIN).",
         (("ca_sin", "Social Insurance No."),)),
    Pack("australia", "Australia", "Asia-Pacific", "Tax File Number and Australian Business Number.",
         (("au_tfn", "Tax File Number"), ("au_abn", "Business Number (ABN)"))),
    Pack("brazil", "Brazil", "Americas", "CPF and CNPJ identifiers.",
         (("br_cpf", "CPF"), ("br_cnpj", "CNPJ"))),
    Pack("spain", "Spain", "Europe", "DNI / NIF national identifier.",
         (("es_dni", "DNI / NIF"),)),
    Pack("france", "France", "Europe", "INSEE social security number.",
         (("fr_insee", "INSEE / Sécu"),)),
    Pack("south_africa", "South Africa", "Africa", "National ID number.",
         (("za_id", "National ID"),)),
    Pack("singapore", "Singapore", "Asia-Pacific", "NRIC / FIN identifier.",
         (("sg_nric", "NRIC / FIN"),)),
)

# Policies every new organisation starts with: all enabled, redact, cloud.
STARTER_POLICIES: tuple[Starter, ...] = (
    Starter("Personal Data (PII)", "Emails, phone numbers, and IP addresses.",
            ("email", "phone", "intl_phone", "ip_address")),
    Starter("Secrets & API Keys", "API keys, tokens, and other credentials.", ("api_key",)),
    Starter("Financial & ID Numbers", "Payment cards, SSNs, IBANs, and passport numbers.",
            ("credit_card", "ssn", "iban", "passport")),
)

# The single policy of the development demo organisation.
DEMO_POLICY = Starter(
    "Default PII Protection",
    "Redact common PII and secrets in prompts and responses",
    ("email", "api_key", "credit_card", "ssn", "iban", "ip_address", "intl_phone"),
)

INTEGRATIONS: tuple[Integration, ...] = (
    Integration("slack", "Slack",
                "Post risk alerts to a Slack channel via an incoming webhook", "💬", True),
    Integration("teams", "Microsoft Teams",
                "Post risk alerts to a Teams channel via an incoming webhook", "👥", True),
    Integration("webhooks", "Webhooks",
                "Send a structured JSON event to your own endpoint on every alert", "🔗", True),
    Integration("google-sheets", "Google Sheets",
                "Export logs and reports to Google Sheets", "📊", False),
)

# Integrations an alert can be delivered to.
DELIVERABLE_SLUGS: tuple[str, ...] = ("slack", "teams", "webhooks")

# Daily request caps by plan; any other plan is unlimited.
PLAN_LIMITS: dict[str, int] = {"free": 200, "team": 20_000}

# Route → provider name in the audit log.
ROUTE_PROVIDERS: dict[str, str] = {"cloud": "openai", "selfhosted": "ollama"}

# Strength of an action.
FLAG, REDACT, BLOCK = 1, 2, 3

# Characters of pending answer text held back while more may come.
STREAM_TAIL = 64

# Chunking and retrieval defaults.
CHUNK_CHARS, CHUNK_OVERLAP, TOP_K, MAX_TOP_K = 1000, 150, 5, 20

# Least score at which a model entity counts.
MIN_ENTITY_SCORE = 0.5

# Text put before retrieved passages in a chat request.
CONTEXT_HEADER = (
    "Relevant context from the organization's knowledge base. "
    "Use it when it helps answer; otherwise rely on your general knowledge.\n\n"
)
# --- end of fixed values ----------------------------------------------------------------------

BY_KEY: dict[str, Detector] = {d.key: d for d in DETECTORS}


class Catalogue:
    """Detectors by key, and the units they are run in: one per distinct (label, expression), so aliases run once."""

    def __init__(self, detectors: tuple[Detector, ...]):
        self.detectors = detectors
        self.units: dict[str, Detector] = {}
        self.unit_of: dict[str, str] = {}
        known: dict[tuple, str] = {}
        for d in detectors:
            shape = (d.label, d.body, d.any_case)
            if shape not in known:
                # a label alone names its first expression; further ones are told apart by their key
                known[shape] = d.label if d.label not in self.units else f"{d.label} {d.key}"
                self.units[known[shape]] = d
            self.unit_of[d.key] = known[shape]


BUILT_IN = Catalogue(DETECTORS)

#: One detector per label: the fixed catalogue has one expression for each.
BY_LABEL: dict[str, Detector] = BUILT_IN.units

_OWN = {(d.body, d.any_case): d for d in reversed(DETECTORS)}


def built_in(d: Detector) -> Detector | None:
    """The detector of the fixed catalogue with the same expression, under whatever key and label."""
    return _OWN.get((d.body, d.any_case))


#: First character of the shapes that open with a rare one. Looking for it first spares the boundary test elsewhere.
_FIRST = {"credit_card": r"\d", "ip_address": r"\d", "iban": "[A-Z]", "passport": "[A-Z]", "fr_insee": "[12]"}

# A sign: every match of the fixed catalogue has one in each of its parts between white space, but for two letters in
# front or one behind, after a single white space, and for blanks alone between the digits of a card.
_FREE = r"[^\d@_\-A]"

#: What no match of the fixed catalogue reaches into: a stretch without signs that says something, from two characters
#: after a white space on, up to three characters before one, so that letters and word boundaries at both ends stay.
GAPS = rf"(?U)(?:^|(?<=\s{_FREE}{{2}}))\s*+[^\s\d@_\-A]{_FREE}*(?={_FREE}{{3}}\s|\z)"

#: Put for each gap: no detector matches across it, and it is no word character.
WINDOW_MARK = "\x01"


def java_regex(d: Detector) -> str:
    """The detector for Spark's regex functions (Unicode classes on)."""
    own = built_in(d)
    first = own and (_FIRST.get(own.key) or (r"\d" if d.body.startswith(r"\b\d") else ""))
    return ("(?iU)" if d.any_case else "(?U)") + (f"(?={first})" if first else "") + d.body


def re2_regex(d: Detector) -> str:
    """The detector for a RE2 engine such as DuckDB's."""
    return ("(?i)" if d.any_case else "") + d.body
