"""Word lists, labels and patterns used as data by the operators.

Every value here is a default; the operators take them as parameters.
"""

# ---- Fixed values: results depend on these exact texts and on their order. ----

# Unicode White_Space, the characters that stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

NAME_COLUMNS = [
    "recipient_legal_name",
    "recipient_operating_name",
    "research_organization_name",
]

KEY_COLUMNS = [
    "recipient_business_number",
    "recipient_legal_name",
    "recipient_operating_name",
    "research_organization_name",
    "recipient_city",
    "recipient_province",
    "recipient_postal_code",
    "recipient_type",
    "owner_org",
]

BILINGUAL_COLUMNS = [
    "recipient_legal_name",
    "recipient_operating_name",
    "research_organization_name",
    "recipient_city",
]

NUMBER_PLACEHOLDERS = [
    "000000000",
    "999999999",
    "99999999",
    "123456789",
    "00000000",
    "N/A",
    "n/a",
    "xxxxxxx",
    "Non actif",
]

DIGIT_PLACEHOLDERS = [
    "000000000",
    "999999999",
    "99999999",
    "123456789",
    "00000000",
]

CENSUS_PLACEHOLDERS = ["00000000", "000000000", "99999999", "999999999", "n/a", "N/A"]

DOMESTIC_COUNTRIES = ["CA", "CANADA"]

# Labels: for-profit, non-profit, person, indigenous, school, other, government, international.
RECIPIENT_TYPES = ["F", "N", "P", "A", "S", "O", "G", "I"]

COMMON_PREFIXES = [
    "canadian",
    "canada",
    "national",
    "society",
    "association",
    "corporation",
    "council",
    "foundation",
    "federation",
    "institute",
    "authority",
    "board",
    "commission",
    "agency",
    "centre",
    "center",
    "network",
    "alliance",
    "coalition",
    "organization",
    "organisation",
]

SCHOOL_WORDS = r"universit|college|c[eé]gep|polytechnic|school district"
CHARITY_NUMBER = r"RR\p{Nd}{1,4}"
COMPANY_WORDS = (
    r"\binc\b|\bincorporated\b|\bltd\b|\bllc\b|\bllp\b|\bcorp\b|corporation|company|limited"
    r"|\blt[ée]e\b|\benr\b|senc\b"
)
NONPROFIT_WORDS = (
    r"society|association|foundation|non-?profit|charitable|charity|federation|council"
    r"|coalition|network|committee|league|guild|chamber of commerce|\bagency\b"
    r"|coop[ée]rati[fv]|\bgroup\b|\bgroupe\b|conservancy|conservation authority"
    r"|\bfestival\b|alliance"
)
INDIGENOUS_WORDS = r"first nation|indigenous|aboriginal|inuit|m[eé]tis|band council"
GOVERNMENT_WORDS = (
    r"government|municipal|city of|town of|village of|province of|regional municipality"
    r"|county of|\bcounty\b|\bministry\b|minist[èe]re\b|\bdepartment\b"
)
HOSPITAL_WORDS = r"hospital|h[ôo]pital"
WORSHIP_WORDS = r"church|parish|paroisse|mosque|synagogue|temple"
MUSEUM_WORDS = r"museum|musee|musée|library|biblioth"
MEDIA_WORDS = r"media|newspaper|journal|press|radio|broadcast"

LABEL_SUFFIXES = {
    "P": " (Individuals)",
    "A": " (Indigenous)",
    "S": " (Academic)",
    "F": " (Festivals)",
    "N": " (Non-profits)",
    "O": " (Other)",
    "G": " (Government)",
    "I": " (International)",
}

LINKAGE_TEXT_COLUMNS = [
    "recipient_legal_name_en",
    "recipient_legal_name_fr",
    "recipient_operating_name_en",
    "recipient_operating_name_fr",
    "research_organization_name_en",
    "research_organization_name_fr",
    "recipient_business_number",
    "recipient_postal_code",
    "recipient_city",
]

# Linkage thresholds, recall and sampling size.
NAME_SIMILARITY_LEVELS = [0.92, 0.88, 0.7]
PRIOR_RECALL = 0.7
RANDOM_PAIRS = 500_000
PAIR_THRESHOLD = 0.5
CLUSTER_THRESHOLD = 0.95
REVIEW_THRESHOLD = 0.7

# ---- End of fixed values. ----
