"""Fixed values. These have to equal published ones for results to agree; they hold no logic."""

# Chat prompt texts and the schema cut.
SYSTEM_PROMPT = (
    "You are a SQL expert. Given a database schema and a natural language question, "
    "generate a valid SQLite query that answers the question.\n"
    "Return only the SQL query, with no explanation or markdown formatting."
)
SCHEMA_HEADING = "### Database Schema:\n"
EXAMPLES_HEADING = "### Examples:\n"
QUESTION_HEADING = "### Question:\n"
SQL_HEADING = "### SQL:"
MAX_SCHEMA_CHARS = 3500
TRUNCATION_MARK = "\n-- (schema truncated)"

# Reward weights by phase.
PHASE1_WEIGHTS = {"execution": 1.0, "syntax": 0.2}
PHASE2_WEIGHTS = {
    "execution": 1.0,
    "success": 0.2,
    "syntax": 0.2,
    "schema_f1": 0.2,
    "format": 0.1,
}

# Keywords that are never table or column names, aggregate names among them.
SQL_STOP_WORDS = [
    "select", "from", "where", "and", "or", "on", "as", "join", "inner", "left", "right", "outer", "group",
    "by", "order", "having", "limit", "distinct", "count", "sum", "avg", "max", "min", "asc", "desc", "not",
    "in", "like", "between", "null", "is", "exists", "case", "when", "then", "else", "end", "union", "except",
    "intersect", "values", "into", "insert", "update", "delete", "create", "drop", "alter", "table", "index",
]
AGGREGATE_NAMES = ["count", "sum", "avg", "max", "min"]
AGGREGATE_MARKERS = ["COUNT", "SUM", "AVG", "MAX", "MIN", "GROUP BY", "HAVING"]

# Openings that mark prose in front of the SQL.
PROSE_OPENING = "^(here|the|this|i |let)"

# Failure categories in report order.
FAILURE_CATEGORIES = [
    "wrong_table",
    "wrong_column",
    "wrong_join",
    "wrong_aggregation",
    "wrong_filter",
    "wrong_order",
    "syntax_error",
    "execution_error",
    "empty_result",
    "other",
]
COARSE_CATEGORIES = ["Syntax Error", "Execution Error", "Wrong Result"]

# Difficulty tiers, with the highest component score of each.
TIER_LIMITS = {"easy": 1, "medium": 3, "hard": 6}
TOP_TIER = "extra"
UNKNOWN_TIER = "unknown"
TIERS = ["easy", "medium", "hard", "extra"]

# Execution limits and evaluation settings.
TIME_LIMIT_SECONDS = 5.0
EMPTY_SQL = "Empty SQL"
NOT_A_QUERY = "Not a query"
TIMEOUT = "Timeout"
EVAL_BATCH_ROWS = 8
LOGGING_STEPS = 10
GATE_ACCURACY = 0.70
CONVERGENCE_GAIN = 0.01
