"""The patterns, word lists and confidences that detection must share to give the expected results."""

from __future__ import annotations

import re

I = re.IGNORECASE

ATOM = r"[A-Z0-9!#$%&'*+/=?^_`{|}~-]"
LABEL = r"[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?"
EMAIL = re.compile(rf"(?<![\w.!#$%&'*+/=?^_`{{|}}~-]){ATOM}+(?:\.{ATOM}+)*@{LABEL}(?:\.{LABEL})+(?![\w@-])", I)

PHONE = re.compile(r"(?<![\w.])(?:\+\s*)?(?:\(\d{2,4}\)|\d)(?:[\s().-]*\d){7,14}(?![\w.])")
PHONE_LABEL = re.compile(r"\b(?:tel(?:ephone)?|phone|mobile|mob\.?|contact(?:\s+number)?|facsimile|fax)\b[^\n]{0,28}$", I)
PHONE_VETO = re.compile(
    r"\b(?:CIN|DIN|ISIN|SEBI|registration|reference|folio|application|invoice|order|ticket|offer|shares?|amount|million|crore|lakh|page|financial\s+year)\b[^\n]{0,36}$", I
)
PHONE_MONEY = re.compile(r"(?:₹|\$|€|£)\s*[\d,.\s]*$")

SSN = re.compile(r"(?<!\d)(\d{3})-(\d{2})-(\d{4})(?!\d)")
SSN_INVALID = ("078-05-1120", "219-09-9999")

CARD = re.compile(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)")
CARD_VETO = re.compile(r"\b(?:CIN|DIN|ISIN|SEBI|registration|reference|folio|application|account)\b[^\n]{0,24}$", I)

IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:.])")

MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = re.compile(rf"(?<!\w)(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}|\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}\s+{MONTH}\s+\d{{4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}})(?!\w)", I)
DATE_FORMATS = ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y")
BIRTH_BEFORE = re.compile(r"(?<!\w)(?:date\s+of\s+birth|birth\s+date|d\.?o\.?b\.?|born(?:\s+on)?)(?!\w)\s*(?:is|:|-)?\s*$", I)
BIRTH_AFTER = re.compile(r"^\s*(?:\(\s*)?(?:date\s+of\s+birth|birth\s+date|d\.?o\.?b\.?)(?!\w)(?:\s*\))?", I)

PERSON_SHAPE = re.compile(r"[A-Z][A-Za-z.'’-]*(?:[ \t]+[A-Z][A-Za-z.'’-]*){1,4}")
ROLE_INTRO = re.compile(
    r"\b(?:contact\s+persons?|promoters?|directors?|chairman|chief\s+(?:executive|financial)\s+officer|CEO|CFO|"
    r"company\s+secretary(?:\s+and\s+compliance\s+officer)?|compliance\s+officer|managing\s+director|whole-time\s+director|joint\s+managing\s+director|engineer)\b"
    r"(?:\s+of\s+our\s+company)?(?:\s*,?\s*(?:are|being|namely))?\s*[:,]?\s*",
    I,
)
ROLE_BEFORE = re.compile(r"(?:contact\s+persons?\s*:\s*|\b(?:being|namely),?\s+|\b(?:CEO|CFO)\s*:\s*)[^.;:]{0,28}$", I)
ROLE_TITLE = (
    r"(?:chairman|chairperson|(?:non[- ]executive|executive|independent|whole[- ]time|managing|joint\s+managing)?\s*director|"
    r"chief\s+(?:executive|financial|operating|risk)\s+officer|company\s+secretary|compliance\s+officer|CEO|CFO)"
)
ROLE_TRAILING = re.compile(rf"(?:\s*\(\s*{ROLE_TITLE}\s*\)|\s*[-–—]\s*{ROLE_TITLE})\s*$", I)
ROLE_STOP = re.compile(
    r"(?:[.]|,\s*(?:company\s+secretary|compliance\s+officer|director|chairman|CEO|CFO)\b|\b(?:telephone|phone|mobile|e-?mail|website|for\s+further|"
    r"are\s+the\s+promoters?|is\s+the\s+promoter|responsible\s+for|who|whose|which|shall|will|having)\b)",
    I,
)
LIST_SEPARATOR = re.compile(r"\s*(?:/|,|;|\band\b)\s*", I)
HONORIFIC = re.compile(r"(?:Mr|Mrs|Ms|Dr)\.?\s+", I)
NOT_NAMES = frozenset(
    """address advisory apartment applicable association associates audit authority avenue bank board branch building business campus capital centre
    chairman chairperson chief city clause committee company complex compliance controls corporate council department director directors estate exchange
    executive factors financial flat floor foundation framework government governance hospital house india industrial industries institute internal
    international law lane limited management managing nagar office officer offer operating parents park partners plaza plot policy promoter promoters
    provisions pursuant registrar regulation report responsibilities risk road secretary section securities services shareholder station street subject
    terms tower trust university""".split()
)

LEGAL_SUFFIX = r"Private[ \t]+Limited|Public[ \t]+Limited|Limited|Ltd\.?|LLP|L\.L\.P\.|Inc\.?|Incorporated|Corp\.?|Corporation|PLC|P\.L\.C\."
LEGAL_COMPANY = re.compile(
    rf"(?<!\w)(?!(?i:{LEGAL_SUFFIX})\b)[A-Z][A-Za-z0-9&.'’()-]*(?:[ \t]+(?:[A-Z][A-Za-z0-9&.'’()-]*|&|and|of|the)){{0,10}}?[ \t]+(?i:{LEGAL_SUFFIX})(?!\w)"
)
FORMERLY = re.compile(r"Formerly[ \t]+", I)
COMPANY_ROLE = re.compile(
    r"(?:(?:name(?:\s+and\s+logo)?\s+of\s+the\s+)?(?:book\s+running\s+lead\s+manager|registrar(?:\s+to\s+the\s+offer)?|escrow\s+collection\s+bank|"
    r"bankers?\s+to\s+the\s+offer|monitoring\s+agency|statutory\s+auditors?|share\s+escrow\s+agent)\s*[:,-]?\s+)+",
    I,
)
COMPANY_LABEL = re.compile(
    r"\b(?:company|issuer|corporate\s+promoter|registrar|book\s+running\s+lead\s+manager|statutory\s+auditor|auditor|industry\s+data\s+provider|"
    r"share\s+escrow\s+agent|monitoring\s+agency|bank|professional\s+firm)\b[^.;:]{0,45}?(?:being|namely|is|:|-)\s*$",
    I,
)
COMMERCIAL = re.compile(r"\b(?:advisory|analytics|associates|bank|industr(?:y|ies)|infra|logistics|motors|ratings|securities|services|technologies|ventures|wealth)\b", I)
NOT_COMPANIES = re.compile(
    r"\b(?:act|agreement|bidders?|board|circulars?|committee|department|document|government|investors?|managers?|ministry|offer|policy|prospectus|"
    r"regulations?|report|rules?|shareholders?|statements?|stock\s+exchanges?|syndicate\s+members?)\b|\bfamily\s+trust\b",
    I,
)
REGULATORS = re.compile(r"^(?:SEBI|Reserve Bank of India|Securities and Exchange Board of India|Government of India|Ministry\b|Department\b)", I)
TRUST = re.compile(r"\btrust\b", I)

ADDRESS_PREFIX = re.compile(
    r"(?:\b(?:registered|corporate|head|branch|mailing|operations?)\s+office(?:\s+address)?\s*(?::|at)?\s*|\baddress\s*:\s*|"
    r"\b(?:facility|office)\s+(?:is\s+)?located\s+at\s*|\blocated\s+at\s*)",
    I,
)
POSTAL_CODE = re.compile(r"(?<!\w)[1-9]\d[0-9Il][ \t-]?[0-9Il]\d{2}(?!\w)")
ADDRESS_FEATURE = re.compile(
    r"\b(?:apartment|avenue|building|bungalow|bunglow|campus|centre|chambers?|complex|department|estate|farms?|flat|floor|gymkhana|highway|hospital|"
    r"industrial|lane|level|marg|nagar|office|park|plot|road|society|station|street|taluka|tower|unit|village|wing)\b",
    I,
)
PREMISE = re.compile(r"(?:\b(?:flat|floor|plot|room|s\.?\s*no\.?|suite|tower|unit|wing)\s*(?:no\.?\s*)?[A-Z0-9]|\b[A-Z]?-?\d{1,4}(?:[/ -]\d{1,4})?\b)", I)
REGION = re.compile(
    r"\b(?:India|Maharashtra|Mumbai|Pune|Delhi|Kolkata|Chennai|Bengaluru|Hyderabad|Ahmedabad|Nashik|Bhopal|Raigad|Gujarat|Karnataka|Tamil Nadu)\b", I
)
CONTACT_START = re.compile(r"\s*[;|]?\s*\b(?:tel(?:ephone)?|phone|mobile|fax|e-?mail|website|contact\s+person)\b\s*:?", I)
LEADING_COMPANY = re.compile(r"^.+?\b(?:Private\s+Limited|Public\s+Limited|Limited|Ltd\.?|LLP|L\.L\.P\.|Inc\.?|Corporation)\b[\s,;:-]*", I)
