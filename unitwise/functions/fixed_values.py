"""Fixed values.

Word lists, lookup tables, thresholds, patterns and formats that results depend
on. They are data, not logic: changing one changes the meaning of an operator.
"""

# --- closed sets -----------------------------------------------------------
STATUSES = ("occupied", "vacant", "notice", "model", "down", "applicant")
TENANT_STATUSES = ("occupied", "notice")
CHARGE_CATEGORIES = (
    "base_rent", "subsidy", "pet", "parking", "storage", "utility", "trash",
    "pest_control", "internet", "admin_fee", "deposit_waiver", "credit_builder",
    "mtm_fee", "damages", "tax_recovery", "other_income", "concession",
    "reimbursed_credit", "loss_to_lease", "vacancy_loss", "other",
)
RENT_CLASS = ("base_rent", "subsidy")
RENT_ADJUSTMENTS = ("concession", "reimbursed_credit", "loss_to_lease", "vacancy_loss")
RENT_DECIDING = RENT_CLASS + RENT_ADJUSTMENTS
REDUCTION_PAIR = ("concession", "reimbursed_credit")
UNIT_CATEGORIES = ("residential", "commercial", "non_unit_income")

# --- status texts ----------------------------------------------------------
STATUS_TEXTS = {
    "occupied": "occupied", "current": "occupied", "c": "occupied",
    "leased": "occupied", "rented": "occupied", "resident": "occupied",
    "pending renewal": "occupied", "occupied-ntv": "notice",
    "vacant": "vacant", "vacant unit": "vacant", "vacant-leased": "vacant",
    "v": "vacant", "available": "vacant", "ready": "vacant",
    "vacant-ready": "vacant", "vacant-unrented": "vacant",
    "notice": "notice", "ntv": "notice", "notice to vacate": "notice",
    "n": "notice", "model": "model", "m": "model", "down": "down",
    "d": "down", "offline": "down", "applicant": "applicant",
    "application": "applicant", "pending": "applicant", "approved": "applicant",
}
# The older workbook profile knows all of these but one.
STATUS_TEXTS_OLDER = {k: v for k, v in STATUS_TEXTS.items() if k != "vacant-unrented"}
# The older printed-document profile knows only these.
STATUS_TEXTS_PRINTED = {
    k: STATUS_TEXTS[k]
    for k in ("occupied", "current", "c", "leased", "occupied-ntv", "vacant", "v",
              "available", "notice", "ntv", "model", "m", "down", "d",
              "applicant", "pending")
}
# Ordered keyword fallbacks; the first that matches decides.
STATUS_KEYWORDS = (
    ("notice", r"notice|ntv", r"no\s*notice"),
    ("vacant", r"vacant|available|unrented", None),
    ("model", r"model", None),
    ("down", r"down|offline|admin", None),
    ("applicant", r"applicant|pending|approved|future", None),
)
STATUS_DEFAULT = "occupied"
STATUS_WHEN_BLANK = "vacant"
# Tenant texts that stand for a status when the sheet has no status column.
TENANT_PLACEHOLDERS = (
    ("vacant", r"^vacant"),
    ("model", r"^model"),
    ("down", r"^(admin|down|office|maint)"),
    ("applicant", r"^(future|applicant|pending)"),
)

# --- charge codes ----------------------------------------------------------
CODE_SPLIT = r"^([a-z0-9]{2,8})\s*[-:]\s*(.+)$"
CHARGE_TOTAL_LINE = r"^([a-z]+\s+)?totals?:?$"
# Ordered rules: (category, words found anywhere, exact abbreviations).
CHARGE_RULES_BEFORE_RENT = (
    ("loss_to_lease",
     ("loss to lease", "gain to lease", "loss to old lease", "gain to old lease", "losstolease"),
     ("ltol", "ltor", "gtl", "ltl")),
    ("vacancy_loss", ("vacancy loss", "vacancy", "vacant"), ("vac",)),
    ("subsidy",
     ("hud", "hap", "subsidy", "housing assistance", "voucher", "section 8"),
     ("hudr", "hap")),
)
BASE_RENT_DESCRIPTIONS = (
    "rent", "base rent", "market rent", "lease rent", "monthly rent", "scheduled rent",
)
BASE_RENT_ABBREVIATION = "rent"
STORAGE_DESCRIPTION = r"(^|[^a-z])st[0-9]+"
CHARGE_RULES_AFTER_RENT = (
    ("pet", ("pet", "animal")),
    ("parking", ("parking", "garage", "carport", "park")),
    ("storage", ("storage", "locker", "parcel", "stor")),
    ("internet", ("wifi", "wi-fi", "internet", "cable", "broadband")),
    ("trash", ("trash", "garbage", "waste", "refuse")),
    ("pest_control", ("pest", "exterminator")),
    ("utility",
     ("water", "sewer", "electric", "gas", "utility", "utilities", "convergent", "rubs")),
    ("credit_builder", ("credit builder", "creditbuilder", "credit report", "creditreport")),
    ("deposit_waiver", ("deposit waiver", "surety", "rhino", "deposit alternative")),
    ("admin_fee",
     ("admin", "service fee", "resident service", "amenity", "move-in", "move in", "application")),
    ("mtm_fee", ("mtm", "month-to-month", "month to month")),
    ("damages", ("damage", "repair", "charge back", "chargeback")),
    ("tax_recovery",
     ("real estate tax", "property tax", "tax recovery", "tax reimbursement", "realestatetax")),
    ("other_income", ("insurance", "liability", "pdlw")),
    ("reimbursed_credit",
     ("scrie", "drie", "senior citizen rent increase", "disability rent increase",
      "rent increase exemption", "tax abatement", "abatement credit", "j-51", "j51")),
    ("concession", ("concession", "discount", "credit", "free", "courtesy", "preferential")),
)

# --- unit texts ------------------------------------------------------------
PLACEHOLDER_ONLY = r"^[-–—/\\ .]*$"
UNIT_NUMBER_SHAPE = r"^([A-Za-z\-]*)?([0-9]+)([A-Za-z]*)$"
ANCILLARY_WORDS = (
    r"\b(parking|garage|carport|antenna|cell\s*tower|rooftop|laundry|storage|locker"
    r"|billboard|signage|sign)\b"
)
COMMERCIAL_WORDS = r"\b(store|retail|office|comm|commercial|restaurant|medical|professional)\b"
COMMERCIAL_IDS = r"^cm\b|^comm"
WORD_IDS = (
    r"^(store|retail|office|comm|laundry|cell|antenna|garage|bsmt|grnd|wlkin|super"
    r"|penthouse|ph)\b"
)
MAX_UNIT_ID = 30
USE_COLUMN = (
    r"bd\s*\/?\s*ba|bed|bath|unit\s*type|floor\s*plan|floorplan|\btype\b|\buse\b|occupancy"
)
NOT_APPLICABLE = r"^(n\/?a|none|null|tbd|unknown)$"
PLACEHOLDER_NAMES = (
    "vacant", "vacant vacant", "available", "empty", "model", "n/a", "na", "-", "--",
)
HIGHLIGHT_PLACEHOLDER_NAMES = ("vacant", "vacancy", "n/a", "none", "-")

# --- dates and numbers -----------------------------------------------------
WHITE_SPACE = " \t\n\v\f\r\u00a0\u2028\u2029\u3000\ufeff"
SERIAL_EPOCH = "1899-12-30"
SERIAL_RANGE = (1000, 80000)
DATE_FORMAT_LETTERS = r"[dmyDMY]"
NOT_A_DATE_FORMAT = r"\[|#|0\.0|%|\$"
MONTH_DAY_YEAR = r"^(\d{1,2})[\/-](\d{1,2})[\/-](\d{2,4})$"
RANGE_SEPARATOR = r"(?i)\s*(?:-|–|to|through)\s*"
NUMBER_PREFIX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"

# --- sheets ----------------------------------------------------------------
MAX_COLUMNS = 80
MAX_TEXT_COLUMN = 12
MAX_INVENTORY_COLUMN = 40
PREVIEW_ROWS = 14
SHEET_UNIT_WORDS = ("unit", "apt", "apartment", "tenant", "resident", "lessee")
SHEET_MONEY_WORDS = ("rent", "charge", "lease")
SHEET_NUMBERS = r"\b\d{3,5}(\.\d{2})?\b"
SHEET_LOOKUP_NAMES = r"(?i)^(dropdowns?|valuelists?|lookups?|_|common sic)"
SHEET_MARKET_NAMES = r"(?i)(demographic|market|costar|reis|axio|photo|map)"
SUMMARY_WORDS = r"(?i)total|summar|occupan|#\s*units|unit\s*status|averages"
SUMMARY_MAX_ROWS = 80
HEADER_CHARS = 8000
COLUMN_HINTS = (
    ("leaseStartDate", r"(lease\s*(start|from|begin)|lease\s*dates)"),
    ("leaseEndDate", r"(lease\s*(end|to|exp)|expir)"),
    ("moveInDate", r"move[\s-]*in"),
    ("moveOutDate", r"move[\s-]*out"),
    ("unitSqft", r"(sq\.?\s*ft|sqft|square\s*(feet|footage)|\bsf\b)"),
    ("unitType", r"(unit\s*type|floor\s*plan|floorplan|bd\/ba|bed|type:)"),
)
COVERAGE_HINTS = (
    ("lease_start_date", r"(lease\s*(start|from|begin)|lease\s*dates)", "tenanted"),
    ("lease_end_date", r"(lease\s*(end|to|exp)|expir|end\s*date)", "tenanted"),
    ("move_in_date", r"move[\s-]*in", "tenanted"),
    ("unit_sqft", r"(sq\.?\s*ft|sqft|square\s*(feet|footage)|\bsf\b)", "all"),
    ("unit_type", r"(unit\s*type|floor\s*plan|floorplan|bd\/ba|bed|type:)", "all"),
)
SAMPLE_WHOLE, SAMPLE_FIRST, SAMPLE_MIDDLE, SAMPLE_LAST = 130, 50, 16, 60
SCALAR_SCAN_ROWS = 20
STREET_HEADER = (
    r"(?i)\d+\s+\w+\s+(ave|st|rd|blvd|dr|ln|way|street|avenue|road|place|court|circle)"
)
BUILDING_HEADER = r"(?i)^building\s+[a-z0-9]"
SUBTOTAL_UNITS = r"(?i)\d+\s*units"
NOT_SUBTOTAL_UNITS = r"(?i)unit\s*(number|#|type|id)"
SUBTOTAL_OCCUPIED = r"(?i)\d+\.?\d*%\s*occupied"

# --- de-duplication priorities ---------------------------------------------
CONVENTIONS = {
    "applicant-over-vacant": {
        "occupied": 5, "notice": 4, "applicant": 3, "model": 2, "down": 2, "vacant": 1},
    "current-occupancy": {
        "occupied": 5, "notice": 4, "vacant": 3, "model": 2, "down": 2, "applicant": 1},
}
OLDER_PRIORITY = {
    "occupied": 100, "notice": 90, "applicant": 80, "model": 50, "down": 40, "vacant": 10}

# --- column roles ----------------------------------------------------------
ROLE_CATEGORY = {
    "rent_component": "base_rent", "subsidy": "subsidy",
    "owner_reduction": "concession", "reimbursed_credit": "reimbursed_credit",
}
UNIT_COLUMNS = (
    "unit_number", "status", "monthly_rent", "market_rent", "subsidy_rent",
    "employee_discount", "concession", "tenant_name", "tenant_name2", "unit_sqft",
    "unit_type", "move_in_date", "move_out_date", "lease_start_date", "lease_end_date",
)

# --- category evidence -----------------------------------------------------
UNGROUNDED_EVIDENCE = ("tenant_or_rent_inference", "unsure")
EVIDENCE_SUPPORT = {
    "residential": ("dwelling_markers",),
    "commercial": ("explicit_use_label", "unit_label", "no_bed_bath"),
    "non_unit_income": ("ancillary_label", "explicit_use_label", "unit_label"),
}

# --- scoring ---------------------------------------------------------------
FIELD_ORDER = (
    "status", "monthlyRent", "tenantName", "unitSqft", "unitType",
    "leaseStartDate", "leaseEndDate", "moveInDate", "moveOutDate",
    "category", "regulation", "charges", "chargeCategories",
)
NAME_SIMILARITY = 0.85
BED_BATH = (
    r"^(\d+|studio)(?:br|bed(?:room)?s?)?[/-]([\d.]+|-+)(?:ba|bath(?:room)?s?)?$"
)

# --- exports ---------------------------------------------------------------
VENDOR_HEADERS = (
    "Unit #", "Unit Type", "Square Foot", "Status", "Tenant Name", "Tenant Paid",
    "Employee Discount", "Subsidy", "Total Rent", "RR Market Rent (Ask)",
    "Rent Roll Concessions", "Move In Date", "Lease Start Date", "Lease End Date",
    "Lease Term",
)
REVIEW_HEADERS = (
    "Unit #", "Building", "Status", "Type", "Sqft", "Monthly Rent", "Market Rent",
    "Subsidy", "Employee Discount", "Concession", "Tenant", "Lease Start", "Lease End",
    "Move In", "Move Out", "Lease Status",
)
VENDOR_MARKERS = (("onesite", ("onesite", "realpage")), ("resman", ("resman",)),
                  ("yardi", ("yardi",)))
OPTIONAL_FIELDS = (
    "building", "unit_type", "unit_sqft", "market_rent", "subsidy_rent",
    "employee_discount", "concession", "total_charges", "tenant_name",
    "lease_start_date", "lease_end_date", "move_in_date", "move_out_date", "lease_status",
)

# --- corpus ----------------------------------------------------------------
CORPUS_EXTENSIONS = (".pdf", ".xlsx", ".xls", ".xlsm")
CORPUS_TYPE = "rent-roll"
REGISTRATION_WORDS = ("dhcr", "registration rent roll")
SCANNED_BELOW_CHARS = 100

# --- progress feed ---------------------------------------------------------
MAX_TIMELINE_EVENTS = 100
THROTTLE_MS = 1000
STALE_MINUTES = 10
