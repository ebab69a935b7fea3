"""Business policy: prices, exchange rates, aliases, column lists and message texts."""

# Ledger header and published column lists.
LEDGER_COLUMNS = [
    "invoice_id", "account_id", "account_name", "contact_email", "region", "industry", "plan",
    "billing_cycle", "seats", "currency", "amount", "discount_pct", "status", "payment_method",
    "signup_date", "invoice_date", "churned", "csat_score", "support_tickets",
]
INVOICE_COLUMNS = [
    "invoice_id", "account_id", "account_name", "region", "plan", "billing_cycle", "seats",
    "currency", "amount_local", "amount_usd_cents", "discount_pct", "status", "invoice_date",
    "signup_date", "churned", "csat_score", "industry", "contact_email", "payment_method",
    "support_tickets",
]
CURATED_INVOICE_COLUMNS = [c for c in INVOICE_COLUMNS if c != "contact_email"] + ["source_row"]
CURATED_ACCOUNT_COLUMNS = [
    "account_id", "account_name", "region", "plan", "seats", "discount_pct", "churned",
    "csat_score", "snapshot_invoice_id", "snapshot_date", "as_of", "mrr_usd_cents",
    "net_revenue_usd_cents", "snapshot_uncertain",
]
SNAPSHOT_ATTRIBUTES = ["account_name", "region", "plan", "seats", "discount_pct", "churned"]

POLICY_VERSION = "ledger-policy-1"
PROVISIONAL_POLICIES = [
    "The recorded amount converted at the stated rate wins over the list price.",
    "An account is described by its latest accepted invoice on or before the as-of date.",
    "An account counts as active unless that invoice says churned.",
    "Mean recurring revenue and churn are taken over all modeled accounts, churned ones included.",
]

# Monthly list price per seat in USD, and USD per currency unit times 100.
PLAN_PRICE = {"starter": 49, "pro": 99, "enterprise": 299}
USD_CENTS_PER_UNIT = {"USD": 100, "EUR": 108, "GBP": 127}
CURRENCY_SYMBOL = {"USD": "$", "EUR": "€", "GBP": "£"}
BILLED_MONTHS = {"monthly": 1, "annual": 10}

# Closed domains and their accepted spellings.
REGIONS = ["NA", "EMEA", "APAC", "LATAM"]
PLAN_ALIASES = {
    "starter": ["starter", "start", "tier 1"],
    "pro": ["pro", "professional", "tier 2"],
    "enterprise": ["enterprise", "ent", "tier 3"],
}
STATUS_ALIASES = {
    "paid": ["paid", "complete", "completed", "success"],
    "pending": ["pending", "in_review", "awaiting"],
    "failed": ["failed", "declined", "error"],
    "refunded": ["refunded", "refund", "charged_back"],
    "void": ["void", "cancelled", "canceled"],
}
CYCLE_ALIASES = {"monthly": ["monthly"], "annual": ["annual", "annually", "yearly"]}
PAYMENT_ALIASES = {
    "credit_card": ["credit card", "credit_card"],
    "ach": ["ach"],
    "wire": ["wire", "wire transfer"],
    "invoice": ["invoice"],
}
CHURN_ALIASES = {1: ["true", "yes", "1", "y"], 0: ["false", "no", "0", "n"]}
REVENUE_STATUSES = ["paid", "refunded"]
EXPOSURE_STATUSES = ["pending", "failed"]

# Numeric limits.
MAX_AMOUNT = 10**12
MAX_CENTS = 10**15
MAX_INTEGER = 2**31 - 1
PRICE_TOLERANCE_CENTS = 2
LOW_CSAT = 2
MAX_ANSWER_ROWS = 100
MAX_SQL_CHARS = 12000
MAX_QUESTION_CHARS = 2000
MAX_HISTORY_TURNS = 3
MAX_HISTORY_BYTES = 12000

# Row error texts.
ERR_INVOICE_DATE = "invoice_date is invalid or unresolved"
ERR_REQUIRED = "{} is required"
ERR_UNKNOWN = "unknown {}"
ERR_CURRENCY = "unknown currency"
ERR_CURRENCY_CODE = "currency marker conflicts with currency column"
ERR_SYMBOL = "invalid currency symbol"
ERR_AMOUNT_FORMAT = "invalid amount format"
ERR_DECIMAL = "invalid decimal"
ERR_DECIMAL_RANGE = "non-finite or out-of-range decimal"
ERR_INTEGER = "invalid integer/range"
ERR_SIGN = "amount sign contradicts status"
ERR_CENTS = "amount exceeds supported integer-cent range"
ERR_DISCOUNT = "discount outside 0..100"
# This engine's own limit: money is DECIMAL(30,12).

# Evidence texts of inferred dates.
EVIDENCE_FORMAT = "column/separator evidence: "
EVIDENCE_CHRONOLOGY = "paired signup/invoice chronology"

# Screening patterns, applied without regard to case.
SCREENING_PATTERNS = {
    "override_attempt": r"\b(?:ignore|override|disregard|bypass)\b.{0,80}\b(?:instructions?|rules?|guardrails?|system prompt)\b",
    "secret_request": r"\b(?:reveal|show|print|give|expose|extract)\b.{0,60}\b(?:api[_ -]?keys?|passwords?|secrets?|system prompt|access tokens?)\b",
    "data_change": r"^\s*(?:delete|drop|truncate|alter|update|insert|attach)\b.{0,60}\b(?:table|database|invoices?|accounts?|from|into)\b",
}

# Functions a curated query may call.
CURATED_FUNCTIONS = [
    "sum", "count", "avg", "min", "max", "round", "coalesce", "ifnull", "nullif", "abs",
    "lower", "upper", "length", "substr", "substring", "date", "strftime", "julianday", "like",
    "trim", "ltrim", "rtrim",
]
