"""Price list, rule tables, lookups and catalogues.

Each is a plain list of rows; ``dim`` turns it into a DataFrame that Spark knows to be
tiny, so joins against it broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severity, from least to most: rank, risk weight, priority base, impact, finding value, timelines.
SEVERITIES = [
    ("info", 1, 1.0, 1, 0.1, 0, "1 month", "6 months"),
    ("low", 2, 2.5, 2, 0.2, 100, "2 weeks", "3 months"),
    ("medium", 3, 5.0, 5, 0.5, 1000, "1 week", "1 month"),
    ("high", 4, 7.5, 8, 0.8, 5000, "72 hours", "2 weeks"),
    ("critical", 5, 10.0, 10, 1.0, 10000, "24 hours", "1 week"),
]
SEVERITY_COLUMNS = (
    "severity string, severity_rank int, weight double, priority int, impact double, "
    "value_usd bigint, immediate string, complete string"
)

# Price in USD per 1000 tokens.
PRICES = [
    ("openai", "gpt-4", 0.03),
    ("openai", "gpt-4-turbo", 0.01),
    ("openai", "gpt-3.5-turbo", 0.002),
    ("openai", "default", 0.01),
    ("anthropic", "claude-3-opus", 0.015),
    ("anthropic", "claude-3-sonnet", 0.003),
    ("anthropic", "claude-3-haiku", 0.00025),
    ("anthropic", "default", 0.01),
    ("ollama", "default", 0.0),
    ("huggingface", "default", 0.001),
]
UNKNOWN_PRICE = 0.005

VULNERABILITY_TYPES = [
    "buffer_overflow",
    "use_after_free",
    "null_pointer_dereference",
    "integer_overflow",
    "sql_injection",
    "command_injection",
    "memory_leak",
    "unknown",
]

# type, severity, CWE, description, CVE ids, remediation steps
VULNERABILITIES = [
    (
        "buffer_overflow", "high", "CWE-120",
        "Buffer overflow vulnerability allowing arbitrary code execution",
        ["CVE-2019-11043", "CVE-2020-1472", "CVE-2021-3156"],
        [
            "Use safe string functions (strncpy, strncat, snprintf)",
            "Enable stack canaries and ASLR",
            "Implement bounds checking",
            "Use memory-safe languages where possible",
        ],
    ),
    (
        "use_after_free", "high", "CWE-416",
        "Use after free vulnerability in memory management",
        ["CVE-2020-0796", "CVE-2019-0708"],
        [
            "Set pointers to NULL after free",
            "Use smart pointers in C++",
            "Implement proper lifetime management",
            "Use memory debugging tools",
        ],
    ),
    (
        "sql_injection", "high", "CWE-89",
        "SQL injection vulnerability allowing database manipulation",
        ["CVE-2019-16928", "CVE-2020-5777"],
        [
            "Use parameterized queries",
            "Implement input validation",
            "Use ORM frameworks",
            "Apply principle of least privilege",
        ],
    ),
    (
        "command_injection", "high", "CWE-78",
        "Command injection allowing arbitrary command execution",
        ["CVE-2020-8597", "CVE-2019-15107"],
        [
            "Avoid shell execution with user input",
            "Use safe APIs for system calls",
            "Implement input sanitization",
            "Use allowlist validation",
        ],
    ),
]
VULNERABILITY_COLUMNS = (
    "vulnerability_type string, known_severity string, cwe_id string, description string, "
    "cve_ids array<string>, remediation array<string>"
)

VERIFICATION = [
    (
        "buffer_overflow",
        [
            "Run static analysis tools (cppcheck, PVS-Studio)",
            "Execute with AddressSanitizer (ASAN)",
            "Perform manual code review of buffer operations",
            "Test with boundary value inputs",
        ],
    ),
    (
        "use_after_free",
        [
            "Run with AddressSanitizer and Valgrind",
            "Review memory management patterns",
            "Check for proper pointer nullification",
            "Test object lifetime scenarios",
        ],
    ),
    (
        "sql_injection",
        [
            "Review all database query constructions",
            "Test with SQL injection payloads",
            "Verify parameterized query usage",
            "Check input validation implementation",
        ],
    ),
    (
        "command_injection",
        [
            "Audit all system call invocations",
            "Test with command injection payloads",
            "Verify input sanitization",
            "Check for shell=True usage",
        ],
    ),
]
DEFAULT_VERIFICATION = "Manual code review required"

EFFORTS = [
    ("buffer_overflow", "high"),
    ("use_after_free", "high"),
    ("sql_injection", "medium"),
    ("command_injection", "medium"),
    ("null_pointer_dereference", "low"),
]

METHOD_FACTORS = [
    ("pattern_matching", 1.2),
    ("crash_signature_analysis", 0.8),
    ("stack_trace_analysis", 1.0),
    ("memory_analysis", 0.6),
]
TYPE_FACTORS = [
    ("buffer_overflow", 0.8),
    ("use_after_free", 0.9),
    ("sql_injection", 1.1),
    ("command_injection", 1.0),
]
EXPLOITABLE = ["buffer_overflow", "command_injection", "sql_injection"]
ATTACK_VECTORS = [
    ("buffer_overflow", "memory_corruption"),
    ("buffer_overflow", "code_execution"),
    ("sql_injection", "database_manipulation"),
    ("sql_injection", "data_exfiltration"),
    ("command_injection", "system_command_execution"),
    ("command_injection", "privilege_escalation"),
    ("use_after_free", "memory_corruption"),
    ("use_after_free", "information_disclosure"),
]
DANGEROUS_FUNCTIONS = [
    ("strcpy", "buffer_overflow"),
    ("strcat", "buffer_overflow"),
    ("sprintf", "buffer_overflow"),
    ("gets", "buffer_overflow"),
    ("free", "use_after_free"),
    ("malloc", "use_after_free"),
]

# Security rules over source text: vulnerability type, pattern.
W = r"[\p{L}\p{N}_]"
SECURITY_RULES = [
    ("buffer_overflow", rf"(?i)(?<!{W})strcpy\s*\("),
    ("buffer_overflow", rf"(?i)(?<!{W})strcat\s*\("),
    ("buffer_overflow", rf"(?i)(?<!{W})sprintf\s*\("),
    ("buffer_overflow", rf"(?i)(?<!{W})gets\s*\("),
    ("buffer_overflow", rf"(?i)(?<!{W})scanf\s*\([^)]*%s"),
    ("sql_injection", r"(?id)SELECT.*\+.*|INSERT.*\+.*"),
    ("sql_injection", r"(?id)query.*\+.*"),
    ("sql_injection", r"(?i)executeQuery\s*\([^)]*\+"),
    ("command_injection", r"(?i)system\s*\([^)]*\+"),
    ("command_injection", r"(?i)exec\s*\([^)]*\+"),
    ("command_injection", r"(?i)os\.system\s*\([^)]*\+"),
    ("command_injection", r"(?i)subprocess\.[^(]*\([^)]*shell\s*=\s*True"),
]
SIGNATURE_RULES = [
    ("buffer_overflow", r"(?id)stack.*overflow"),
    ("buffer_overflow", r"(?id)heap.*overflow"),
    ("buffer_overflow", r"(?id)buffer.*overflow"),
    ("use_after_free", r"(?id)use.*after.*free"),
    ("use_after_free", r"(?id)heap.*corruption"),
    ("use_after_free", r"(?id)double.*free"),
    ("null_pointer_dereference", r"(?id)sigsegv"),
    ("null_pointer_dereference", r"(?id)access.*violation"),
    ("null_pointer_dereference", r"(?id)null.*pointer"),
]
# Per-language line rules: language, category, pattern.
SOURCE_RULES = [
    ("c", "buffer_overflow", rf"(?i)(?<!{W})strcpy\s*\("),
    ("c", "buffer_overflow", rf"(?i)(?<!{W})strcat\s*\("),
    ("c", "buffer_overflow", rf"(?i)(?<!{W})sprintf\s*\("),
    ("c", "buffer_overflow", rf"(?i)(?<!{W})gets\s*\("),
    ("c", "memory_leak", rf"(?i)(?<!{W})malloc\s*\("),
    ("c", "memory_leak", rf"(?i)(?<!{W})calloc\s*\("),
    ("c", "memory_leak", rf"(?i)(?<!{W})realloc\s*\("),
    ("python", "code_injection", rf"(?i)(?<!{W})eval\s*\("),
    ("python", "code_injection", rf"(?i)(?<!{W})exec\s*\("),
    ("python", "deserialization", r"(?i)pickle\.loads"),
    ("python", "deserialization", r"(?i)yaml\.load\s*\("),
    ("java", "sql_injection", r"(?i)Statement\.execute\s*\("),
    ("java", "sql_injection", r"(?i)createStatement\s*\("),
    ("java", "deserialization", r"(?i)ObjectInputStream"),
    ("java", "deserialization", r"(?i)readObject\s*\("),
]

# Lower-case words of which a text must hold one before the pattern can match: a plain
# substring test spares nearly all texts the pattern search.
NEEDLES = {
    pattern: words
    for (_, pattern), words in zip(
        SECURITY_RULES,
        [
            ["strcpy"], ["strcat"], ["sprintf"], ["gets"], ["scanf"], ["select", "insert"], ["query"], ["executequery"],
            ["system"], ["exec"], ["os.system"], ["subprocess."],
        ],
    )
}
NEEDLES |= {
    pattern: words
    for (_, _, pattern), words in zip(
        SOURCE_RULES,
        [
            ["strcpy"], ["strcat"], ["sprintf"], ["gets"], ["malloc"], ["calloc"], ["realloc"], ["eval"], ["exec"],
            ["pickle.loads"], ["yaml.load"], ["statement.execute"], ["createstatement"], ["objectinputstream"], ["readobject"],
        ],
    )
}

BENCHMARKS = [
    ("drivers_per_hour", 20.0),
    ("cost_per_driver", 0.5),
    ("cpu_efficiency", 0.7),
    ("memory_efficiency", 0.8),
    ("vulnerability_find_rate", 0.1),
]

LANGUAGE_OF_EXTENSION = {
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "py": "python", "java": "java", "js": "javascript", "ts": "typescript",
    "rs": "rust", "go": "go", "cs": "csharp", "php": "php", "rb": "ruby",
    "swift": "swift", "kt": "kotlin",
}

# Model catalogue: name, size in GB, specialty, expected quality, priority, token limit.
MODELS = [
    ("deepseek-coder:33b", 18.0, "code", "very_high", 1, 16384),
    ("codellama:34b-instruct", 19.0, "code", "very_high", 2, 16384),
    ("starcoder2:15b", 9.1, "code", "very_high", 3, 8192),
    ("qwen2.5-coder:32b", 19.0, "code", "very_high", 4, 16384),
    ("wizardcoder:33b", 18.0, "code", "very_high", 5, 16384),
    ("devstral:latest", 14.0, "code", "high", 6, 16384),
    ("deepseek-r1:32b", 19.0, "general", "high", 7, 16384),
    ("qwen3:32b", 20.0, "general", "high", 8, 16384),
    ("yi:34b", 19.0, "general", "high", 9, 16384),
    ("gemma3:27b", 17.0, "general", "medium", 10, 8192),
    ("mixtral:latest", 26.0, "general", "high", 11, 32768),
    ("magistral:24b", 14.0, "general", "medium", 12, 8192),
    ("phi4:14b", 9.1, "general", "medium", 13, 8192),
    ("llama3:latest", 4.7, "baseline", "baseline", 14, 8192),
]
MODEL_COLUMNS = "model_name string, size_gb double, specialty string, expected_quality string, priority int, max_tokens int"
# Model sets of the study.
MODEL_SETS = {
    "validation": ["llama3:latest"],
    "quick_test": ["llama3:latest", "deepseek-coder:33b"],
    "code_specialists": [
        "deepseek-coder:33b", "codellama:34b-instruct", "starcoder2:15b",
        "qwen2.5-coder:32b", "wizardcoder:33b", "devstral:latest",
    ],
    "top_performers": ["deepseek-coder:33b", "codellama:34b-instruct", "starcoder2:15b", "qwen2.5-coder:32b"],
    "comprehensive": [
        "deepseek-coder:33b", "codellama:34b-instruct", "starcoder2:15b", "qwen2.5-coder:32b",
        "wizardcoder:33b", "devstral:latest", "deepseek-r1:32b", "qwen3:32b", "yi:34b",
        "gemma3:27b", "mixtral:latest", "magistral:24b", "phi4:14b", "llama3:latest",
    ],
    "large_models": [
        "deepseek-coder:33b", "codellama:34b-instruct", "qwen2.5-coder:32b", "wizardcoder:33b",
        "deepseek-r1:32b", "qwen3:32b", "yi:34b",
    ],
    "medium_models": ["starcoder2:15b", "devstral:latest", "gemma3:27b", "magistral:24b", "phi4:14b"],
    "baseline_comparison": ["llama3:latest", "deepseek-coder:33b", "mixtral:latest"],
}

# Study phases: name, categories, model set, repositories per category (NULL = all).
PHASES = [
    ("validation", ["c_extra_small"], "validation", 2),
    ("code_specialists_small", ["c_extra_small"], "code_specialists", 3),
    ("top_performers_medium", ["c_easy_small"], "top_performers", 3),
    ("baseline_comparison", ["c_extra_small", "c_easy_small"], "baseline_comparison", 2),
    ("large_models_analysis", ["c_easy_small", "cpp_easy_small"], "large_models", 2),
    ("comprehensive_thesis", ["c_extra_small", "c_easy_small", "cpp_easy_small"], "comprehensive", None),
]

# Repository catalogue: category, repository, build minutes; in listed order, all built with cmake.
REPOSITORIES = {
    "c_easy_small": [
        ("zlib", 2), ("libpng", 3), ("libjpeg-turbo", 4), ("libwebp", 3), ("lz4", 2), ("cJSON", 1), ("libspng", 2),
    ],
    "c_easy_big": [
        ("libxml2", 8), ("curl", 6), ("freetype", 5), ("libarchive", 7), ("mbedtls", 8),
        ("libgit2", 10), ("libevent", 5), ("zstd", 6),
    ],
    "c_extra_small": [("miniz", 1), ("stb", 1), ("minimp3", 1), ("tinyexpr", 1)],
    "cpp_easy_small": [
        ("nlohmann-json", 3), ("fmt", 4), ("glm", 2), ("spdlog", 3), ("re2", 4),
        ("cereal", 2), ("rapidjson", 2), ("yaml-cpp", 4), ("tinyxml2", 2), ("pugixml", 2),
    ],
    "cpp_easy_big": [
        ("protobuf", 15), ("abseil-cpp", 12), ("leveldb", 8), ("rocksdb", 20),
        ("opencv", 25), ("grpc", 30), ("folly", 18),
    ],
}


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return repr(value)


def dim(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal table. ``schema`` is ``name type, ...``."""
    columns = [part.strip().split(" ", 1) for part in schema.split(",")]
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in columns)
    table = spark.sql(f"select * from values {body} as t({names})")
    return table.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])


def rule_array(rows: Sequence[tuple[str, ...]]) -> Column:
    """Rules (last part the pattern) as one literal ARRAY<STRUCT<label, category, pattern, needles>>.

    ``label`` is the first part, ``category`` the one before the pattern. Rules are data
    inside the row's expressions: a row tries only those whose needle it holds, and the
    plan does not grow with their number.
    """
    return F.array(
        *[
            F.struct(
                F.lit(row[0]).alias("label"),
                F.lit(row[-2]).alias("category"),
                F.lit(row[-1]).alias("pattern"),
                F.array(*[F.lit(word) for word in NEEDLES.get(row[-1], [""])]).alias("needles"),
            )
            for row in rows
        ]
    )


def may_match(rule: Column, low: Column) -> Column:
    """Whether the lower-cased text holds a needle of the rule (the empty one always)."""
    return F.exists(rule["needles"], lambda word: low.contains(word))


def lookup(key: Column, rows: dict | Sequence[tuple], default=None) -> Column:
    """Value of ``key`` in a small fixed mapping, as one CASE expression."""
    items = list(rows.items()) if isinstance(rows, dict) else list(rows)
    out = F.when(key == items[0][0], F.lit(items[0][1]))
    for name, value in items[1:]:
        out = out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, [(row[0], row[1]) for row in SEVERITIES])
