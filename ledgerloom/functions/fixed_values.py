"""Code lists, labels, bounds and patterns that results must carry literally."""

# Participation code -> label of the holder role.
HOLDER_ROLES = {
    "1": "1-PRETITULAR",
    "2": "2-PREFIADOR",
    "3": "3-PREREPRESENTANTE",
    "4": "4-PREDONANTE",
    "5": "5-PREAUTORIZADO",
    "6": "6-PREBENEFICIARIO",
    "7": "7-PRETUTOR",
    "A": "A-AUTORIZADO",
    "B": "B-BENEFICIARIO",
    "C": "C-CLIENTE/ASEGURADO",
    "D": "D-DONANTE",
    "E": "E-TUTOR",
    "F": "F-FIADOR",
    "G": "G-GARANTE",
    "H": "H-HIPOTECANTE NO DEUDOR",
    "K": "K-FIADOR DESACTIVADO",
    "M": "M-MANCOMUNADO",
    "O": "O-OPERADOR",
    "P": "P-PROMOTOR",
    "R": "R-REPRESENTANTE",
    "S": "S-SUBROGANTE",
    "T": "T-TITULAR",
    "U": "U-USUFRUCTUARIO",
    "V": "V-AVALISTA",
    "X": "X-TITULAR ASEGURADO",
    "Y": "Y-ADMINISTRADOR",
    "Z": "Z-ACCIONISTA",
}
HOLDER = "T-TITULAR"

# Status codes of the legacy and of the new core.
LEGACY_STATUS = {"A": "ACTIVA", "I": "INACTIVA", "C": "CANCELADA", "P": "PRECANCELADA", "M": "MONEDERO"}
CORE_STATUS = {"A": "ACTIVA", "C": "CANCELADA"}
CANCELLED = "CANCELADA"

# Person-type codes.
PERSON_TYPES = {"301": "PF", "721": "PM"}

# Upper-inclusive balance bounds with their labels; above the last bound TOP applies.
BALANCE_BANDS = [
    (0, "(00) Sin saldo"),
    (1, "(01) menor a 1"),
    (50, "(02) 1 a 50"),
    (100, "(03) 50 - 100"),
    (1000, "(04) 100 - 1k"),
    (2500, "(05) 1k - 2.5k"),
    (5000, "(06) 2.5k - 5k"),
    (10000, "(07) 5k - 10k"),
    (15000, "(08) 10k - 15k"),
    (20000, "(09) 15k - 20k"),
    (25000, "(10) 20k - 25k"),
    (50000, "(11) 25k - 50k"),
    (100000, "(12) 50k - 100k"),
    (150000, "(13) 100k - 150k"),
    (200000, "(14) 150k - 200k"),
    (250000, "(15) 200k - 250k"),
    (300000, "(16) 250k - 300k"),
    (350000, "(17) 300k - 350k"),
    (400000, "(18) 350k - 400k"),
    (450000, "(19) 400k - 450k"),
    (500000, "(20) 450k - 500k"),
]
BALANCE_TOP = "(21) + 500k"
BALANCE_NONE = "(00) Sin saldo"

# Fixed values: (level 3, level 4) -> product family.
PRODUCT_FAMILIES = {
    ("Captacion", "Nomina"): "NOMINA",
    ("Captacion", "Inversion"): "INVERSION",
    ("Captacion", "Ahorro"): "AHORRO",
    ("Captacion", "Colaboradores"): "COLABORADOR",
    ("BIG", "Programas Sociales"): "PGS",
}
OTHER_FAMILY = "SECTOR CORPORATIVO"
TERM_PRODUCTS = ["PF-0022", "PF-0002"]

# Customer kinds in the master-id table, in the order they are tried.
MASTER_KINDS = ["CLIENTE_ALNOVA", "CLIENTE_FINACLE", "CLIENTE_UNICO", "CLIENTE_ICU"]

# Source systems.
LEGACY = "ALNOVA"
CORE = "FINACLE"

# Allowed values of catalogue columns.
SCHEMA_TYPES = ["RAW", "CURADO", "CRYSTAL", "TEMPORAL", "NO CLASIFICADO", "OTRO"]
SOURCE_REVIEWS = ["candidate", "approved", "excluded"]
RUN_REVIEWS = ["pending", "approved", "excluded"]
IMPORT_STATES = ["idle", "planned", "executed", "failed"]

# Schemas whose tables count as published results and as physical inputs.
RESULT_SCHEMAS = ["cd_baz_bdclientes", "rd_baz_bdclientes", "rd_baz_bdsopoperlog"]
INPUT_SCHEMAS = ["cd_baz_bdclientes", "rd_baz_bdclientes", "rd_baz_bdsopoperlog", "tmp_baz_bdclientes"]

# Schema prefixes per diagram group, tried in this order.
GROUP_PREFIXES = [
    ("raw", ["rd_baz_bdclientes."], "rd_"),
    ("cd", ["cd_baz_bdclientes."], "cd_"),
    ("cu", ["cu_baz_bdclientes.", "ws_ec_cu_baz_bdclientes."], "cu_"),
]

# Layer label per table-name prefix.
LAYERS = {"cd_": "Crystal (cd_)", "rd_": "Raw (rd_)", "cu_": "Curada (cu_)"}
NO_LAYER = "Logica derivada"

# Section titles each document kind must carry.
STRUCTURAL_SECTIONS = [
    "1. Referencia rapida y ficha del producto",
    "2. Fuentes de datos",
    "3. Flujo general del proceso",
    "4. Matriz de trazabilidad",
    "5. Transformaciones",
    "6. Reglas de negocio",
    "7. Proceso paso a paso detallado",
    "8. Convenciones y navegacion",
]
STEP_SECTIONS = [
    "1. Fuentes de datos",
    "2. Flujo general del proceso",
    "3. Matriz de trazabilidad",
    "4. Transformaciones",
    "5. Reglas de negocio",
    "6. Proceso paso a paso detallado",
    "7. Criterio de aceptacion",
]
DOCUMENT_PREFIX = "DA_REQ_CD_IT_"

# Transformation subtype labels per function, in the order they are joined.
SUBTYPES = [
    ("Agregacion", ["SUM", "COUNT", "MIN", "MAX", "AVG"]),
    ("Conv. tipo", ["CAST", "TRY_CAST"]),
    ("Limpieza", ["TRIM"]),
    ("Cascada", ["COALESCE"]),
    ("Clasificacion", ["CASE"]),
]
CONSTANT_SUBTYPE = "Constante"
DEFAULT_SUBTYPE = "Calculo"
RENAME_SUBTYPE = "Renombre"
EMPTY_MARK = "—"
STEP_MARK = "●"
NO_CONTRIBUTION = "No genera campos finales directos"

# Tokens per logical type, tried in this order.
NAME_TYPES = [
    ("date", ["fecha", "fec_", "_fec", "date"]),
    ("timestamp", ["timestamp", "ts", "hora", "datetime"]),
    ("boolean", ["flag", "indicador", "es_", "tiene_", "activo"]),
    ("number", ["id", "folio", "numero", "saldo", "monto", "importe", "total"]),
]
