"""Values that define the results and must be exactly these."""

# --- Fixed values: discovery -------------------------------------------------------------------------------------

#: Directories that are never entered, at any depth (the last but one is this engine's own output).
SKIPPED_DIRECTORIES = (
    ".git", "node_modules", ".venv", "venv", "env", "__pycache__", "knotwork-out", "dist", "build", ".tox",
    ".pytest_cache", ".ruff_cache", ".mypy_cache", ".idea", ".vscode", "target", ".next", ".nuxt",
)
#: The one directory with a leading dot that is entered.
ALLOWED_DOT_DIRECTORY = ".github"
#: Kind of file by lower-case suffix; other suffixes are "other" and dropped.
KIND_BY_SUFFIX = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java",
    ".md": "markdown", ".markdown": "markdown", ".rst": "text", ".txt": "text", ".toml": "config",
    ".yaml": "config", ".yml": "config", ".json": "config", ".ini": "config", ".cfg": "config",
}

# --- Fixed values: extraction ------------------------------------------------------------------------------------

#: Calls of these names make no edge.
PYTHON_BUILTINS = frozenset((
    "print", "len", "range", "list", "dict", "set", "tuple", "str", "int", "float", "bool", "type", "isinstance",
    "issubclass", "open", "input", "sorted", "sum", "min", "max", "abs", "round", "map", "filter", "zip",
    "enumerate", "any", "all", "iter", "next", "reversed", "hash", "id", "repr", "format", "getattr", "setattr",
    "hasattr", "delattr", "vars", "dir", "callable", "super", "object", "Exception", "ValueError", "TypeError",
    "KeyError", "IndexError", "AttributeError", "RuntimeError", "NotImplementedError", "StopIteration",
    "FileNotFoundError", "OSError", "globals", "locals", "exec", "eval", "staticmethod", "classmethod", "property",
    "bytes", "bytearray", "memoryview", "frozenset", "complex",
))
#: Method-like words of Java that name no method.
JAVA_RESERVED = frozenset(("if", "for", "while", "switch", "catch", "synchronized", "return"))
#: Patterns; all but the Go imports and Markdown links are used with MULTILINE, the first groups that matched count.
JS_IMPORT = (
    r"""^\s*(?:import\s+(?:[\w*{}\s,]+?\s+from\s+)?["']([^"']+)["']"""
    r"""|const\s+[\w{}\s,]+?\s*=\s*require\(["']([^"']+)["']\)"""
    r"""|export\s+(?:\*|\{[\w\s,]+\})\s+from\s+["']([^"']+)["'])"""
)
JS_FUNCTION = r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"
JS_ARROW = r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>"
JS_CLASS = r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?"
GO_IMPORT_BLOCK = r"import\s*\(([^)]*)\)"
GO_IMPORT_SINGLE = r'import\s+"([^"]+)"'
GO_QUOTED = r'"([^"]+)"'
GO_FUNCTION = r"^\s*func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s+)?(\w+)"
GO_TYPE = r"^\s*type\s+(\w+)\s+(?:struct|interface)"
RUST_USE = r"^\s*use\s+([^\s;{]+)"
RUST_FUNCTION = r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"
RUST_TYPE = r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([\w.]+\*?);"
JAVA_CLASS = r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+([\w.]+))?"
JAVA_METHOD = (
    r"^\s*(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|synchronized\s+)+"
    r"[\w<>\[\],\s.?]+?\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?\s*\{"
)
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+?)\s*$"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"

# --- Fixed values: search and analysis ---------------------------------------------------------------------------

TERM = r"[A-Za-z_][A-Za-z0-9_]+"
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "shall", "can", "of", "in",
    "on", "at", "to", "for", "with", "from", "by", "as", "if", "this", "that", "these", "those", "it", "its", "i",
    "you", "we", "they", "what", "which", "who", "how", "why", "when", "where", "about", "into", "through", "over",
    "out", "up", "down", "off", "than", "then", "so", "very", "just", "use", "uses", "used", "using",
)
#: Modules too common to count as hubs.
NOISE_MODULES = (
    "module::os", "module::sys", "module::re", "module::json", "module::pathlib", "module::typing",
    "module::collections", "module::dataclasses", "module::abc", "module::functools", "module::itertools",
    "module::logging",
)
#: Types whose match scores one more.
FAVOURED_TYPES = ("function", "class", "module")
CHARACTERS_PER_TOKEN = 4
SEEDS = 8
TOP_HUBS, FALLBACK_HUBS, TOP_SURPRISES, MOST_QUESTIONS = 20, 5, 10, 6
LARGEST_COMMUNITY = 0.25
LOUVAIN_SEED = 42
QUESTION_BY_TYPE = {
    "function": ("How does the `", "` function work?"),
    "class": ("What does the `", "` class do?"),
    "module": ("What relies on the `", "` module?"),
    "file": ("Walk me through `", "`."),
}
QUESTION_OTHERWISE = ("What is `", "`?")
QUESTION_SUBSYSTEMS = "How are the major subsystems connected?"
QUESTION_ENTRY = "What's the architectural entry point of this project?"

# --- Fixed values: wording of answers ------------------------------------------------------------------------------

SAY_NO_TERMS = "No usable terms in question. Try keywords from the codebase."
SAY_NO_MATCH = "No matching nodes for terms: {}"
SAY_DID_YOU_MEAN = "Did you mean one of these high-degree nodes?"
SAY_UNKNOWN = "Unknown node: {}"
SAY_NO_ENDPOINT = "One or both endpoints not found: {} -> {}"
SAY_NO_PATH = "No path between {} and {}"
HEAD_ANSWER = "QUESTION: {}\nTERMS: {}\nSEEDS: {}\nDEPTH: {} STRATEGY: {} BUDGET: {} tokens\n"
HEAD_EXPLAIN = "NODE: {}\n"
HEAD_PATH = "PATH ({} nodes):\n"
HEAD_AFFECTED = "AFFECTED by {} (depth {}):\n"
