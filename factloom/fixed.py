"""FIXED VALUES: word lists, patterns, formats and sentences that results must equal.

They are data, not logic, and are kept together in natural order.
"""

# File formats a reader or writer names as a method.
FORMATS = ["parquet", "csv", "json", "orc", "text", "avro", "delta", "xml"]

# Writer verbs that name their target directly, and verbs that need `.write` upstream.
TARGET_VERBS = ["saveAsTable", "insertInto", "writeTo"]
FORMAT_WRITE_VERBS = ["save"] + FORMATS

# Verbs that register a temp view.
VIEW_VERBS = [
    "createOrReplaceTempView",
    "createTempView",
    "createGlobalTempView",
    "createOrReplaceGlobalTempView",
    "registerTempTable",
]

# Verbs that change rows but neither the columns nor where they come from.
PASSTHROUGH_VERBS = [
    "filter", "where", "orderBy", "sort", "sortWithinPartitions", "limit", "offset",
    "distinct", "dropDuplicates", "drop_duplicates", "repartition", "coalesce",
    "cache", "persist", "unpersist", "checkpoint", "localCheckpoint", "hint",
    "sample", "alias", "as", "observe", "dropna", "fillna", "na", "replace",
    "exceptAll", "intersect", "intersectAll", "subtract",
]

# Medallion stages in the order data moves through them.
STAGES = ["landing", "raw", "staging", "bronze", "silver", "gold", "platinum", "curated", "serving", "mart"]

# Activity type -> label.
ACTIVITY_LABELS = {
    "TridentNotebook": "Notebook",
    "Copy": "Copy data",
    "RefreshDataflow": "Dataflow",
    "SparkJobDefinition": "Spark job",
    "ExecutePipeline": "Pipeline",
    "Lookup": "Lookup",
    "IfCondition": "If condition",
    "ForEach": "For each",
    "SqlServerStoredProcedure": "Stored procedure",
    "WebActivity": "Web",
    "Wait": "Wait",
}

# Suffixes that decorate a lakehouse path segment with its item kind.
KIND_SUFFIX = r"(?i)\.(Lakehouse|Warehouse|Datawarehouse)$"

# Storage inside a table folder, never the table itself.
STORAGE_LEAF = r"(?i)^[_.]|^part-|\.(?:json|parquet|crc|checkpoint|txt|avro)$"

# abfss://container@account/path, and the container that names no workspace.
ABFSS = r"(?i)^abfss://([^@/]+)@[^/]+/(.*)$"
GENERIC_CONTAINER = "onelake"
ABFSS_WORKSPACE = (
    r"abfss://([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})@"
)

# Scan patterns over notebook source, each with a word every match contains.
# (?U) gives \w and \b their Unicode meaning.
_FMT = "|".join(FORMATS)
_PATH = r"""[^'"\n]+"""
READ_PATTERNS = [
    ("table", r"""(?iU)spark\.table\(\s*['"]([\w. ]+)['"]"""),
    ("table", r"""(?iU)spark\.read[\w.]*\.table\(\s*['"]([\w. ]+)['"]"""),
    ("load", rf"""(?iU)\.load\(\s*['"]({_PATH})['"]"""),
    ("read", rf"""(?iU)\.read[\w.]*\.(?:{_FMT})\(\s*['"]({_PATH})['"]"""),
    ("from", r"""(?iU)\bFROM\s+([\w.`]+)"""),
    ("join", r"""(?iU)\bJOIN\s+([\w.`]+)"""),
]
WRITE_PATTERNS = [
    ("saveastable", r"""(?iU)\.saveAsTable\(\s*['"]([\w. ]+)['"]"""),
    ("insertinto", r"""(?iU)\.insertInto\(\s*['"]([\w. ]+)['"]"""),
    ("save", rf"""(?iU)\.save\(\s*['"]({_PATH})['"]"""),
    ("write", rf"""(?iU)\.write[\w.()'"= ]*\.(?:{_FMT})\(\s*['"]({_PATH})['"]"""),
    ("insert", r"""(?iU)\bINSERT\s+INTO\s+([\w.`]+)"""),
    ("create", r"""(?iU)\bCREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+([\w.`]+)"""),
    ("merge", r"""(?iU)\bMERGE\s+INTO\s+([\w.`]+)"""),
    ("update", r"""(?iU)\bUPDATE\s+([\w.`]+)\s+SET\b"""),
    ("delete", r"""(?iU)\bDELETE\s+FROM\s+([\w.`]+)"""),
]
IMPORT_LINE = r"(?mU)^\s*(?:from\s+[\w.]+\s+import\b|import\s+[\w.]+)"
VIEW_VERB_CALL = r"""(?U)\.(?:%s)\(\s*['"]([^'"\n]+)['"]""" % "|".join(VIEW_VERBS)
TEMP_VIEW_SQL = (
    r"(?iU)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+)?TEMP(?:ORARY)?\s+VIEW\s+"
    r"(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+)"
)
SQL_MAGIC = r"(?iU)^\s*%%\s*(?:spark-)?sql\b"
SQL_MAGIC_BODY = r"(?isU)^\s*%%\s*(?:spark-)?sql\b[^\n]*\n(.*)$"
ANY_MAGIC = r"(?U)^\s*%%\s*\w"

# Statement heads.
INSERT_TARGET = r"(?isU)^\s*INSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?([\w.`]+)"
CTAS_TARGET = r"(?isU)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+([\w.`]+)\s+.*?\bAS\b\s+SELECT"
MERGE_TARGET = r"(?isU)^\s*MERGE\s+INTO\s+([\w.`]+)"
UPDATE_TARGET = r"(?isU)^\s*UPDATE\s+([\w.`]+)"
DELETE_TARGET = r"(?isU)^\s*DELETE\s+FROM\s+([\w.`]+)"
TEMP_VIEW_TARGET = (
    r"(?isU)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+)?TEMP(?:ORARY)?\s+VIEW\s+"
    r"(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+)"
)
MERGE_USING = r"(?iU)\bUSING\s+([\w.`]+)(?!\s*\()"

# Last segment of a JSON path: $['a']['b'] or $.a
JSON_PATH_LEAF = r"""(?U)\[\s*['"]([^'"]+)['"]\s*\]|\.(\w+)$"""

# Separator line between pasted cells, and between the levels of an activity name.
CELL_SEPARATOR = r"(?i)\n\s*#\s*---\s*cell\s*---\s*\n"
NAME_SEPARATOR = " / "

# Verdicts and the sentences that explain them.
TRACED, COLUMNS_ONLY, BARE = "traced", "columns-only", "bare"
REASON_PREDATES = "This run predates coverage reporting, so why is not recorded."
REASON_DATAFRAME = (
    "Written through the DataFrame API. The %s engine derives column lineage from SQL only, "
    "so the columns moved are not knowable from this run."
)
REASON_DYNAMIC = (
    "Its query is built from an f-string or a variable, so the SQL was skipped rather than guessed at."
)
REASON_UNPARSABLE = "The cell that writes it could not be parsed."
REASON_NONE = "The run resolved no column lineage for this table and gave no reason."
REASON_UNREADABLE = "Its schema could not be read: %s"
REASON_UNRESOLVED = (
    "Its schema could not be read from OneLake — the table may not exist yet, "
    "or this principal cannot read it."
)
REASON_NO_COLUMNS = "No columns were resolved for this table."
REASON_READ_ONLY = "Read but not written here, so this run had no derivation to record."

# Lines of a run's log about what its coverage lacks; the first one is the stub engine's only.
NOTE_DATAFRAME = (
    "[coverage] %s cell(s) write through the DataFrame API. The stub engine reads those chains symbolically and abstains on "
    "anything it cannot resolve exactly, so an uncovered write below is a chain it would not guess at — not an empty "
    "notebook. Spark's analyzer resolves these fully where a JVM is available."
)
NOTE_DYNAMIC = (
    "[coverage] %s cell(s) build their SQL dynamically (f-string or variable); the query text is not knowable without "
    "running the cell, so they were skipped."
)
NOTE_UNPARSABLE = "[coverage] %s cell(s) could not be parsed as Python."
NOTE_UNCOVERED = "[coverage] %s of %s written table(s) got no column lineage: %s"

# A run as Markdown.
REPORT_TITLE = "# Sandbox run"
REPORT_STEPS = "## Steps"
REPORT_FLOWS = "## Column lineage"
REPORT_FLOW_HEAD = ["| to | from | via |", "| --- | --- | --- |"]
REPORT_NO_FLOWS = "None resolved. See the gaps below for why."
REPORT_GAPS = "## Gaps"
REPORT_NO_GAPS = "Every table the run wrote has column-level lineage."
REPORT_NO_REASON = "no column lineage resolved"
