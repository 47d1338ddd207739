"""Patterns, word lists, thresholds and lookup tables.

They decide what counts as a match, so they have to stay exactly as they are for results to
be comparable. Patterns are written for Java's regex engine; ``(?U)`` makes ``\\b``, ``\\w``,
``\\d`` and ``\\s`` cover all of Unicode.
"""

def _from(first: str, pattern: str) -> str:
    """The same matches, sought only where one of the letters that a match begins with stands."""
    flags, rest = pattern.split(")", 1)
    return f"{flags})(?=[{first}])(?:{rest})"


# What a letter also stands for when case is ignored in all of Unicode.
ALSO = {"I": "\u0130\u0131", "K": "\u212a", "S": "\u017f"}


# Letters that stand for others when case is ignored in all of Unicode.
ODD_LETTERS = ["\u0130", "\u0131", "\u212a", "\u017f"]


def _headed(heads: list[str], pattern: str) -> str:
    """The same matches of a pattern that ignores case, sought only where its first letters stand.

    Plain sets of both cases are tested several times as fast as letters that ignore case.
    """
    first, *others = [f"[{''.join(c + c.lower() + ALSO.get(c, '') for c in letters)}]" for letters in heads]
    then = f"(?=.{''.join(others)})" if others else ""
    return f"(?U)(?={first}){then}(?i)(?:{pattern.removeprefix('(?iU)')})"


# ---- page markers ---------------------------------------------------------------------
# Both begin with a literal, which Java seeks in leaps.
PAGE_MARKER = r"(?U)====================(?i)=*\s*\nPAGE\s+(\d+)\s*\n={20,}"
LOOSE_PAGE_MARKER = r"(?U)==========(?i)=*\s*\n\s*PAGE\s+(\d+)\s*\n\s*={10,}"
RULED_PAGE_HEADER = r"(?U)── Page (\d+) ──"
ANY_PAGE_LABEL = r"(?iU)PAGE\s+(\d+)"
BATCH_MARKER = r"(?iU)===\s*PAGE\s*\d+\s*==="

# ---- text grids -----------------------------------------------------------------------
CELL_BORDER = "│"
BORDER_CHARS = "┌┐└┘├┤┬┴┼─═│"
TABLE_LABEL = r"(?iU)\[Table\s+\d+[^\]]*\]\s*\n"
TABLE_END = r"(?im)^(?:\[Table|={10,})"
GRID_VALUE = (
    r"(?iU)\d+\.?\d*\s*%"
    r"|\d+\.?\d*\s+to\s+1"
    r"|\d+\.?\d*\s*x\b"
    r"|\.\d+\s*%"
    r"|\d{4}-\d{2}-\d{2}"
    r"|[A-Z][a-z]+\s+\d+,\s+\d{4}"
)
ANY_DIGIT = r"(?U)\d"  # each value of a grid has one
STITCH_VALUE = r"(?iU)\d+\.?\d*\s*%|\d+\.?\d*\s+to\s+1|\d+\.?\d*\s*x\b"
THRESHOLD = (
    r"(?iU)[><=≥≤]\s*\d+\.?\d*\s*%"
    r"|[><=≥≤]\s*\d+\.?\d*\s*x"
    r"|\d+\.?\d*\s*x\s+and"
    r"|<\s*\d+\.?\d*\s+and"
)
MERGED_TOKEN = r"(?U)\d+\.?\d*\s*%|\d+\.?\d*\s+to\s+1\S*"
MERGED_NUMBER = r"(?U)\d+\.?\d*"
KNOWN_GRID_TITLE = "Leverage Ratio Grid"
KNOWN_GRID_COLUMNS = ["≥ 3.00x", "< 3.00x and ≥ 2.00x", "< 2.00x and ≥ 1.00x", "< 1.00x"]
KNOWN_GRID_ROW = (
    r"(?iU)│\s*(LIBOR Loans|ABR Loans|Commitment Fee Rate)\s*"
    r"│\s*(\.?\d+\.?\d*%)\s*"
    r"│\s*(\.?\d+\.?\d*%)\s*"
    r"│\s*(\.?\d+\.?\d*(?:\.?\d+)?)\s*"
    r"│\s*(\.?\d+\.?\d*%)\s*│"
)
KNOWN_GRID_TOKEN = r"(?U)\.?\d+\.?\d*%"
TERM_CODE = (
    r"(?iU)\b(?:DLR|DLI|Table|Section|Schedule|Annex|Exhibit|Article)\s*[#\.]?\s*"
    r"[\dIVXA-Z]+[\d\.]*\b"
)
TERM_CELL = r"│([^│\n]{4,60})│"
TERM_NUMERIC_CELL = r"(?U)^[\d,\.\s€$£%]+$"
TERM_WORD = r"(?U)\b[A-Za-z][a-zA-Z]{2,}\b"
TERM_CELL_ACRONYM = r"(?U)\b[A-Z]{2,}\b"
TERM_ACRONYM = r"(?U)\b[A-Z]{2,5}\b"
TERM_STOP = ["THE", "AND", "FOR", "NOT", "ARE", "ITS"]

# ---- definitions and covenants --------------------------------------------------------
RATIO_VALUE = (
    r"(?iU)\d+\.?\d*\s+to\s+1[.:\d]*"
    r"|\d+\.?\d*\s*:\s*1[.:\d]*"
    r"|\d+\.?\d*\s*x\b"
    r"|\d+\.?\d*\s+times"
)
DEFINITION = (
    r'(?sU)"?([A-Z][A-Za-z\s\-]{2,60})"?\s+(?:shall\s+)?means?\s+'
    r'(.{30,600}?)(?=\n\n|"[A-Z]|\z)'
)
COVENANT = _from("SWM", (
    r"(?isU)(?:shall\s+not\s+(?:permit|allow|cause)|"
    r"will\s+not\s+permit|"
    r"maintain[s]?\s+(?:a\s+)?|"
    r"shall\s+maintain)\s+"
    r"(?:the\s+)?([A-Z][A-Za-z\s\-]{2,60})\s+"
    r"(?:to\s+be\s+)?(?:greater\s+than|less\s+than|"
    r"exceed|below|above|at\s+least|not\s+less\s+than|"
    r"not\s+more\s+than|in\s+excess\s+of)\s+"
    r"([^.;]{5,80}?)(?=[.;])"
))
COVENANT_LOOKBACK = 200
PERIODS = [
    (r"(?iU)Investment\s+Grade\s+Period", "Investment Grade Period"),
    (r"(?iU)Borrowing\s+Base\s+Trigger\s+Period", "Borrowing Base Trigger Period"),
]

# ---- dates, parties, amounts, signatures, programs, numbers ---------------------------
AGREEMENT_DATES = [
    _headed(["DEA", "AFS"], (
        r"(?iU)(?:dated\s+as\s+of|effective\s+(?:as\s+of|date(?:\s+of)?)|as\s+of|dated)\s+"
        r"([A-Z][a-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{4})"
    )),
    _headed(["T", "H"], r"(?iU)this\s+\w+(?:\s+\w+)?\s*,?\s*dated\s+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})"),
]
# Names are tried only where capitals run up to a bracket.
NAMED_PARTY = (
    r"(?U)(?=[A-Z][A-Z ,\.]{3,80}+\s*+\()([A-Z][A-Z ,\.]{3,80}?)\s*\(\s*[*\"']\s*(?:the\s+)?"
    r"([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)?)\s*[*\"']\s*\)"
)
BETWEEN_PARTIES = _headed(["B", "E"], (
    r"(?iU)between\s*\n\s*([A-Z][A-Z\s]{3,60}?)\s*\n\s*and\s*\n\s*([A-Z][A-Z\s]{3,80})"
))
AMOUNT = _headed(["EUGJCX", "USBPHD", "RDPYF"], r"(?iU)(EUR|USD|GBP|JPY|CHF|XDR)\s*(\d[\d,\.]+(?:\s*(?:million|billion))?)")
SIGNER_NAME = _headed(["NB", "AY"], r"(?iU)(?:Name|By)\s*:\s*([A-Z][A-Za-z\s\-]{2,60}?)(?:\n|$)")
SIGNER_TITLE = _headed(["TPF", "IOU"], r"(?iU)(?:Title|Position|Function)\s*:\s*([A-Za-z][A-Za-z\s\-,\.]{4,80}?)(?:\n|$)")
BORROWER_SIDE = _from(r"FB(\"'", r"(?iU)\b(?:FOR THE BORROWER|BORROWER)\b|[(\"']Borrower[\"')]")
BANK_SIDE = _from(r"FIW(\"'", (
    r"(?iU)\bFOR THE BANK\b|[(\"']Bank[\"')]|\bIBRD\b|\bWorld Bank\b|\bINTERNATIONAL BANK\b"
))
LAST_SIDE = f"(?s).*(?:({BANK_SIDE})|(?:{BORROWER_SIDE}))"
PARTY_LOOKBACK = 800
PROGRAMS = [
    r"(?U)in\s+support\s+of\s+(?:the\s+)?(?:[Bb]orrower\'?s?\s+)?"
    r"([A-Z][A-Za-z\s\-\(\)]{4,120}?)\s*(?:Program|Programme)",
    _from("cif", (
        r"(?U)(?:carry\s+out|implement|financing\s+of)\s+"
        r"(?:the\s+)?([A-Z][A-Za-z\s\-\(\)]{4,120}?)\s*(?:Program|Programme)"
    )),
    r"(?U)(?:the\s+)([A-Z][A-Za-z\s\-\(\)]{4,120}?)\s*(?:Program|Programme)\s+"
    r"(?:for\s+Results|Development\s+Policy|Investment)",
]
# Words of which every match of the pattern holds one; a text without them is not searched.
PROGRAM_WORDS = [["support"], ["carry", "implement", "financing"], ["Results", "Policy", "Investment"]]
# How every match of the pattern ends; begins with a literal.
PROGRAM_ENDS = {2: r"(?U)Program(?:me)?\s+(?:for\s+Results|Development\s+Policy|Investment)"}
PROGRAM_SUFFIX = r"(?iU)(Program|Programme)(?:\s+for\s+Results|\s+Development\s+Policy)?"
REFERENCE_NUMBER = _headed(["LPCA", "ORG", "AONJR"], (
    r"(?iU)(?:LOAN|PROJECT|CONTRACT|AGREEMENT)\s+(?:NUMBER|NO\.?|#|N°)\s*([A-Z0-9][\w\-]{2,20})"
))
# Patterns that look at nothing outside their match: no word ends, no ends of lines or texts.
WHOLE = {PAGE_MARKER, LOOSE_PAGE_MARKER, *AGREEMENT_DATES, NAMED_PARTY, AMOUNT, *PROGRAMS, REFERENCE_NUMBER}
# Patterns of which that holds for matches that end with a line break; the others end with the text.
WHOLE_LINES = {SIGNER_NAME, SIGNER_TITLE}

# ---- key name → value format ----------------------------------------------------------
KEY_FORMAT_CASCADE = [
    ("percentage", [
        r"\b(loan|libor|abr|sofr|prime|base)\s+rate\b",
        r"\bapplicable\s+margin\b",
        r"\bcommitment\s+fee\b",
        r"\b(utilization|unused)\s+fee\b",
        r"\bletter\s+of\s+credit\s+fee\b",
        r"\bfacility\s+fee\b",
        r"\bspread\b",
        r"\bmargin\b.*\butilization\b",
        r"\butilization\b.*\bmargin\b",
        r"\brate\b.*\b(utilization|leverage|grid)\b",
        r"\b(utilization|leverage|grid)\b.*\brate\b",
    ]),
    ("ratio", [
        r"\bcovenant\b",
        r"\b(leverage|coverage|interest\s+coverage|interest\s+expense)\s+ratio\s+covenant\b",
        r"\b(maximum|minimum|not\s+to\s+exceed|not\s+less\s+than)\b.*\bratio\b",
        r"\bfirst\s+lien\b.*\bratio\b",
        r"\bsenior\s+secured\b.*\bratio\b",
        r"\bdebt\s+service\s+coverage\b",
        r"\btotal\s+net\s+leverage\b",
        r"\bfixed\s+charge\s+coverage\b",
        r"\basset\s+coverage\b",
    ]),
    ("date", [
        r"\b(agreement|effective|closing|execution)\s+date\b",
        r"\b(maturity|termination|expiration|expiry)\s+date\b",
        r"\b(first|initial|final)\s+(payment|due|scheduled)\s+date\b",
        r"\bdate\s+of\s+(agreement|amendment|restatement)\b",
        r"\bcommencement\s+date\b",
    ]),
    ("amount", [
        r"\b(total|aggregate|maximum|commitment)\s+(amount|facility|commitment)\b",
        r"\b(revolving|term|swingline)\s+(loan|facility|commitment)\s+(amount|limit|cap)\b",
        r"\bborrowing\s+base\b(?!.*\bpercentage\b)(?!.*\butilization\b)",
        r"\bcredit\s+(limit|cap|facility)\b",
        r"\b(letter\s+of\s+credit)\s+sublimit\b",
    ]),
    ("ratio", [
        r"\bratio\s+[<>≥≤]\s*\d+\.\d+x\b",
        r"\b[<>≥≤]\s*\d+\.\d+x\b.*\bratio\b",
    ]),
]
ALWAYS_PERCENTAGE = (
    r"\b(loan\s+rate|libor\s+rate|abr\s+rate|sofr\s+rate|"
    r"commitment\s+fee|facility\s+fee|applicable\s+margin)\b"
)
ALWAYS_RATIO = r"\b(covenant|not\s+to\s+exceed|not\s+less\s+than)\b"
FORMAT_TEXTS = {
    "percentage": "X.XX% (e.g. 2.25%)",
    "ratio": "X.XX to 1.00 (e.g. 4.50 to 1.00)",
    "date": "YYYY-MM-DD (e.g. 2015-11-02)",
    "amount": "$X,XXX,XXX or $XXXmm (e.g. $500,000,000)",
    "text": "free text",
}
UNKNOWN_FORMAT_TEXT = "unknown format"
PERCENTAGE_TERMS = [
    "rate", "margin", "spread", "fee", "coupon", "yield",
    "libor", "sofr", "abr", "prime", "base rate", "commitment",
    "utilization fee", "unused fee", "letter of credit",
]
RATIO_TERMS = [
    "leverage ratio", "coverage ratio", "interest coverage",
    "debt service", "fixed charge", "current ratio",
    "net debt", "ebitda", "ebitdax", "ltv", "loan to value",
    "asset coverage", "interest expense ratio", "first lien",
]
DATE_TERMS = [
    "date", "maturity", "expiry", "expiration", "effective",
    "closing", "termination", "amendment",
]
NAME_FORMAT_CASCADE = [
    ("ratio", r"\bratio\b|\bleverage\b|\bcoverage\b"),
    ("percentage", r"\brate\b|\bfee\b|\bmargin\b|\bspread\b|\byield\b|\bpercentage\b|\bpercent\b|\b%\b"),
    ("date", r"\bdate\b|\bdeadline\b|\bclosing\b|\bmaturity\b|\bexpir\b|\beffective\b"),
    ("currency", r"\bamount\b|\bprincipal\b|\bcurrency\b|\beur\b|\busd\b|\bloan\b|\bfee amount\b|\bthreshold\b"),
    ("number", r"\bnumber\b|\bcount\b|\bquantity\b|\bdatasets\b|\binstallment share\b"),
]
OBLIGATION_TERMS = [
    "shall", "must", "obligation", "covenant", "condition",
    "requirement", "clause", "agreement", "provision",
    "permitted", "restricted", "prohibited", "allowed",
    "period", "term", "duration", "trigger", "threshold",
]

# ---- value formats --------------------------------------------------------------------
VALUE_RULES = {
    "percentage": (r"(?U)^\d+\.?\d*\s*%$", "2.25%"),
    "ratio": (r"(?iU)^\d+\.?\d*\s+to\s+1[.:\d]*", "4.50 to 1.00"),
    "date": (r"(?U)^\d{4}-\d{2}-\d{2}$", "2015-11-02"),
    "currency": (r"(?U)[A-Z]{2,3}[\s,]?\d|^\d[\d,\.]+$", "EUR 1,000,000"),
    "number": (r"(?U)^\d[\d,\.]*$", "145"),
    "text": (r".+", "any text"),
}
SCORED_VALUE_RULES = {
    "percentage": (r"(?U)^\d+\.?\d*\s*%$", "2.25%"),
    "ratio": (r"(?iU)^\d+\.?\d*\s+to\s+1[.:\d]+", "4.50 to 1.00"),
    "date": (r"(?U)^\d{4}-\d{2}-\d{2}$", "2015-11-02"),
    "text": (r".+", "any text"),
}
RATIO_TAIL = r"(?U)\s*to\s*1[.:]\s*0*"
BARE_NUMBER = r"(?U)^\d+\.?\d*$"
MONTHS = {
    "january": "01", "february": "02", "march": "03", "april": "04",
    "may": "05", "june": "06", "july": "07", "august": "08",
    "september": "09", "october": "10", "november": "11", "december": "12",
}
MONTH_DAY_YEAR = r"(?U)(\w+)\s+(\d{1,2}),?\s+(\d{4})"
PLAIN_MONTH_DAY_YEAR = r"(?U)(\w+) (\d+), (\d{4})"
SLASH_DATE = r"(?U)(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
YEAR_FIRST_DATE = r"(?U)(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
CURRENCY_KEY_WORDS = ["currency", "devise", "monnaie"]
CURRENCY_RESCUES = [
    r"(?iU)expressed in\s+([A-Z]{3})",
    r"(?iU)\(expressed in\s+([A-Z]{3})\)",
    r"(?iU)amount.*?\(([A-Z]{3})\)",
    r"(?U)\b(EUR|USD|GBP|XOF|JPY|CHF|MAD|TND)\b",
]
# A literal in lower case that every match of the rescue holds; none for the last.
CURRENCY_RESCUE_WORDS = ["expressed in", "(expressed in", "amount", None]
CONFIDENCE_WORDS = {"high": 0.85, "medium": 0.6, "low": 0.35}

# ---- retrieval ------------------------------------------------------------------------
DEFINITION_SIGNAL = (
    r'(?iU)means\b|shall mean|is defined as|refers to|"definitions"|'
    r"herein defined|defined term|as used herein|"
    r"\bis\b|\bequals\b|\bshall be\b|\bwill be\b|\bcalculated as\b|"
    r"\bpayable at\b|\bpayable in\b|\bamounts to\b|\brepresents\b"
)
# The same signals in a lower-case text without ODD_LETTERS: phrases, words that every other signal holds, the other signals.
SIGNAL_PHRASES = ["shall mean", "is defined as", "refers to", '"definitions"', "herein defined", "defined term", "as used herein"]
SIGNAL_WORDS = ["means", "is", "equals", "shall be", "will be", "calculated as", "payable at", "payable in", "amounts to", "represents"]
SIGNAL_WORD = r"(?U)means\b|\b(?:is|equals|shall be|will be|calculated as|payable at|payable in|amounts to|represents)\b"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+|\n{2,}"
# The same breaks with the end mark before them, without looking back at every blank.
SENTENCE_END = r"(?U)([.!?])\s+|\n{2,}"

# ---- registry -------------------------------------------------------------------------
CSV_COLUMNS = [
    "keyName", "value", "score", "page", "expected_format",
    "format_valid", "reason", "found_in", "rule_context",
]
STEP_LABELS = {
    "": "En attente",
    "queued": "En file d'attente",
    "ocr_processing": "OCR en cours…",
    "ocr_done": "OCR terminé",
    "initializing_agents": "Initialisation des agents…",
    "building_document_map": "Construction de la carte du document…",
    "document_map_ready": "Carte du document prête",
    "extracting_fields": "Extraction des champs…",
    "saving_results": "Sauvegarde des résultats…",
    "completed": "Terminé",
    "error": "Erreur",
}
MILESTONES = {
    "ocr_processing": 5.0, "ocr_done": 20.0, "initializing_agents": 25.0, "agents_ready": 30.0,
    "building_document_map": 35.0, "document_map_ready": 45.0, "extracting_fields": 50.0,
    "saving_results": 95.0, "completed": 100.0,
}
TEMPLATE_CATALOG = [
    # role, subtype, display_name, template_file, prompt_terms, prompt_rules
    ("banking", "loan", "Loan / Credit Agreement", "banking_loan.json", "loan_terms", "loan_rules"),
    ("banking", "isda", "ISDA Master Agreement", "banking_isda.json", "isda_terms", "isda_rules"),
    ("insurance", "invoice", "Insurance Policy / Premium Invoice", "insurance_policy.json", "invoice_terms", "invoice_terms"),
    ("compliance", "compliance_report", "Compliance / Risk Assessment Report", "compliance_report.json", "compliance_terms", "compliance_terms"),
    ("admin", "loan", "Loan / Credit Agreement", "banking_loan.json", "loan_terms", "loan_rules"),
    ("admin", "isda", "ISDA Master Agreement", "banking_isda.json", "isda_terms", "isda_rules"),
    ("admin", "invoice", "Insurance Policy / Invoice", "insurance_policy.json", "invoice_terms", "invoice_terms"),
    ("admin", "compliance_report", "Compliance Report", "compliance_report.json", "compliance_terms", "compliance_terms"),
]
# The texts of reasons and issues; {} is filled in.
MESSAGES = {
    "rescued": "Currency code extracted from table header",
    "accepted": "Format valid, confidence sufficient",
    "no_answer": "LLM returned invalid response",
    "high_embedding": "High embedding confidence, format verified",
    "no_scored_answer": "Validator LLM returned unexpected format; extraction value used",
    "empty": "null or empty value",
    "null": "null value",
    "date": "cannot normalize date — expected YYYY-MM-DD, got '{}'",
    "mismatch": "format mismatch — expected {} (e.g. {}), got '{}'",
    "scored_date": "date format wrong, expected YYYY-MM-DD",
    "scored_mismatch": "value '{}' does not match expected format '{}' (e.g. {})",
    "hint": "value doesn't match definition hint",
}
