"""Fixed values.

The values in this module must equal the ledger semantics described in
thresholds).  They are stated plainly, in natural order, in one place.
Category sets, rule tables, recode maps and opening balances are *inputs*
(DataFrames / parameters); only synthetic defaults live here.
"""

# ---- fixed values: labels -------------------------------------------------
UNCLASSIFIED = "Sin clasificar"
INCOME_KIND = "Ingresos"
EXPENSE_KIND = "Gastos"
KINDS = ("Ingresos", "Gastos")
ORIGINS = ("Caja de Ahorro", "Tarjeta de crédito")
EXCLUDED_FROM_BALANCE = "No va"          # the only category left out of W1
OPENING_MARKER_KINDS = ("Saldo Inicial", "Saldo Final")

# ---- fixed values: month abbreviations for labels ("Ene 25") ---------------
MONTH_ABBR = ("Ene", "Feb", "Mar", "Abr", "May", "Jun",
              "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")

# ---- fixed values: statement lines that are not movements (F1) ------------
BALANCE_LINE_TEXTS = ("SALDO ANTERIOR", "SALDO FINAL", "SALDO INICIAL", "TOTAL")

# ---- fixed values: categories needing a label (F7), upper-cased ------------
NEEDS_LABEL_TEXTS = ("NAN", "NONE", "SIN CLASIFICAR", "PENDIENTE")
BLANK_TEXTS = ("nan", "none")            # P14: treated as empty text

# ---- fixed values: header keywords and aliases of raw statements (S1, P2) --
HEADER_KEYWORDS = ("fecha", "concepto", "debito", "débito", "credito", "crédito")
COLUMN_ALIASES = {
    "date": ("fecha", "date", "fec"),
    "concept": ("concepto", "descripcion", "descripción", "detalle", "glosa", "movimiento"),
    "debit": ("debito", "débito", "cargo", "egreso", "monto débito", "monto debito"),
    "credit": ("credito", "crédito", "abono", "ingreso", "monto crédito", "monto credito"),
    "balance": ("saldo", "balance", "saldo final"),
    "reference": ("referencia", "ref", "num. operacion", "nro operacion", "operacion"),
}
STATEMENT_SEPARATORS = (",", ";", "\t", "|")

# ---- fixed values: stop words of the pattern miner (G1) --------------------
MINING_STOP_WORDS = (
    "COMPRA", "REDIVA", "PAGO", "TRANSFERENCIA", "DEBITO", "CREDITO", "POS", "WEB",
    "TARJETA", "ITAU", "CAJA", "DE", "AHORRO", "CRE", "DEB", "CAMBIOSST", "CAMBIOSOP",
    "VARIOS", "VISA", "LINK", "ILINK", "TRASPASO", "DESDE", "HASTA", "CUENTA",
    "A", "EN", "LA", "EL",
)
# ---- fixed values: stop words of the text model (P15, M1) ------------------
MODEL_STOP_WORDS = (
    "COMPRA", "REDIVA", "PAGO", "TRANSFERENCIA", "DEBITO", "CREDITO", "POS", "WEB",
    "TARJETA", "ITAU", "CAJA", "DE", "AHORRO", "CRE", "DEB", "CAMBIOSST", "CAMBIOSOP",
    "VARIOS", "VISA", "LINK", "ILINK", "TRASPASO", "DESDE", "HASTA", "CUENTA",
)

# ---- fixed values: thresholds and sizes -------------------------------------
TOP_MOVEMENTS_N = 15
TOP_MOVEMENTS_MIN_ABS = 500
TOP_CATEGORIES_N = 8
AVERAGE_MONTHS = 12
TREND_MONTHS = 6
TREND_BAND = 0.15
VS_AVG_WARN = 1.0
VS_AVG_BAD = 1.2
VS_AVG_BAR_CAP = 1.5
MINING_MIN_COUNT = 3
MINING_PURITY_PCT = 85
MODEL_CONFIDENCE_MIN = 0.82
GROUP_MOVEMENTS_SHOWN = 30
CONCEPT_CHARS = 60
EXAMPLE_CHARS = 55
CHANGE_EXAMPLE_CHARS = 35
CHANGE_EXAMPLES = 15
SERIAL_DATE_LOW = 20000
SERIAL_DATE_HIGH = 80000
SERIAL_DATE_EPOCH = "1899-12-30"

# ---- synthetic defaults (inputs, not reference data) -------------------------
DEFAULT_INCOME_CATEGORIES = ("Sueldo", "Otros ingresos")
DEFAULT_SYSTEM_CATEGORIES = ("No va", "Traspaso", "Traspasos internos")
TRAINING_EXCLUDED = ("No va", "Traspaso", "", "Saldo Inicial", "Saldo Final", UNCLASSIFIED)
