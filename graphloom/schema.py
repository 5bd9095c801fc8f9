"""Table schemas and fixed enumerations of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = "id string, type string, qualified_name string, file_path string, line_start int, line_end int, provenance string, kind string, http_method string, http_path string, metadata map<string,string>, seq long"
EDGES = "source string, target string, type string, weight double, provenance string, metadata map<string,string>, seq long"
ENDPOINTS = "id string, method string, path string, handler string, file_path string, line_start int, line_end int, framework string, middleware array<string>, decorators array<string>, metadata map<string,string>"
SYMBOL = "struct<name:string,qualified_name:string,kind:string,file_path:string,line_start:int,line_end:int,decorators:array<string>,parameters:array<string>,parent:string,calls:array<string>>"
IMPORT = "struct<module:string,names:array<string>,is_default:boolean,is_namespace:boolean,alias:string,line:int>"
EXPORT = "struct<name:string,is_default:boolean,line:int>"
PARSE_ERROR = "struct<message:string,line:int,col:int>"
ROUTE = "struct<kind:string,method:string,path:string,handler:string,middleware:array<string>,line_start:int,line_end:int>"
FINDINGS = "endpoint string, engine string, rule string, severity string, title string, description string, file_path string, line_number int, recommendation string, seq int"
CHANGES = "seq long, path string, type string, old_path string, content_hash string, ts timestamp"
SNIPPETS = "node_id string, node_type string, qualified_name string, file_path string, line_start int, line_end int, source_code string, relevance_score double, token_count int"

# Node types, edge types, HTTP methods and severities in their order.
NODE_TYPES = ["endpoint", "controller", "service", "repository", "entity", "dto", "config", "security_rule", "database_table", "cache", "kafka_topic", "external_api", "test", "middleware", "validator", "error_handler", "module", "function", "class", "file"]
EDGE_TYPES = ["calls", "depends_on", "queries", "publishes", "subscribes", "secured_by", "validates", "uses", "tested_by", "configured_by", "cached_by", "maps_to", "accepts", "returns", "belongs_to", "imports", "exports", "inherits", "implements"]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
GOALS = ["security", "performance", "architecture", "full"]

# The edge types that each goal follows; full follows all.
GOAL_EDGES = {
    "security": ["secured_by", "validates", "calls", "configured_by", "depends_on", "belongs_to"],
    "performance": ["queries", "cached_by", "calls", "uses", "depends_on", "belongs_to"],
    "architecture": ["calls", "depends_on", "belongs_to", "implements", "uses"],
    "full": EDGE_TYPES,
}
# The weight of node types for each goal; all others weigh 1.
GOAL_BOOSTS = {
    "security": {"middleware": 2.5, "validator": 2.5, "config": 2.0, "controller": 1.5, "endpoint": 3.0},
    "performance": {"repository": 3.0, "entity": 2.5, "service": 2.0, "controller": 1.5, "endpoint": 2.0},
    "architecture": {"controller": 2.0, "service": 2.0, "repository": 2.0, "module": 1.5, "endpoint": 2.0},
    "full": {"endpoint": 2.0, "controller": 1.5, "service": 1.5, "repository": 1.5},
}
# Layers from the outside in.
LAYERS = {"endpoint": 0, "middleware": 1, "controller": 2, "service": 3, "repository": 4, "entity": 5}
# File name extensions and the language each stands for.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "java": "java", "go": "go", "cs": "c_sharp",
}
# Extensions of files that hold no text, and names of files and folders that are not scanned.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "ico", "svg", "webp", "woff", "woff2", "ttf", "eot", "zip", "tar", "gz", "bz2", "exe", "dll", "so",
    "dylib", "pdf", "doc", "docx", "mp3", "mp4", "wav", "avi", "db", "sqlite", "sqlite3",
]
IGNORED = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".graphloom", "*.pyc", "*.lock", "dist", "build", ".next", "coverage",
    ".pytest_cache", ".mypy_cache", ".ruff_cache",
]


def goal_edges(spark: SparkSession) -> DataFrame:
    """(goal, edge_type); a few dozen rows."""
    return spark.createDataFrame([(g, e) for g, es in GOAL_EDGES.items() for e in es], "goal string, edge_type string")


def goal_boosts(spark: SparkSession) -> DataFrame:
    """(goal, node_type, boost); a few dozen rows."""
    rows = [(g, t, b) for g, ts in GOAL_BOOSTS.items() for t, b in ts.items()]
    return spark.createDataFrame(rows, "goal string, node_type string, boost double")
