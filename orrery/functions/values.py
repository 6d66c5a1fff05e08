"""Fixed values that results depend on."""

# Search channels: weights of the fusion.
CHANNEL_WEIGHTS = {"purpose": 0.25, "businessContext": 0.05, "paths": 0.20, "keywords": 0.20, "classes": 0.15, "functions": 0.10, "importsInternal": 0.025, "importsExternal": 0.025}
CHANNEL_CAP, PAGE_SIZE, PAGE_MIN, PAGE_MAX = 100, 30, 10, 100

# Exclusion presets: suffixes and fragments of paths.
EXCLUSIONS = {
    "tests": ((".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.js", "_test.go", "_spec.rb"), ("/__tests__/", "/tests/", "/test/", "/spec/")),
    "vendor": ((), ("/node_modules/", "/vendor/", "/third_party/", "/.yarn/")),
    "config": ((".lock", ".yaml", ".yml", ".toml", ".ini"), ("/.github/", "/.vscode/", "/.idea/")),
    "generated": ((".min.js", ".min.css", ".d.ts.map", ".js.map", ".pb.go", ".pb.ts"), ("/dist/", "/build/", "/out/", "/generated/", "/.next/")),
    "docs": ((".md", ".mdx", ".rst", ".txt"), ("/docs/", "/documentation/")),
    "build": ((".lock",), ("/dist/", "/build/", "/target/", "/.gradle/", "/.cache/")),
}

# Languages by extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "md": "markdown", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml", "sh": "shell"}

# Ignored directories and files.
IGNORED_DIRECTORIES = (".git", "node_modules", "dist", "build", ".next", ".turbo", ".cache", "coverage")
IGNORED_FILENAMES = (".DS_Store", "package-lock.json", "yarn.lock", "bun.lockb", "Cargo.lock", "Pipfile.lock", "poetry.lock")
IGNORED_EXTENSIONS = (
    ".lock", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp", ".bmp", ".tiff", ".svg", ".pdf", ".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".mp4", ".mov", ".avi", ".mkv", ".webm",
    ".mp3", ".wav", ".flac", ".ogg", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".class", ".jar", ".exe", ".dll", ".so", ".dylib", ".wasm", ".bin",
)

# Mirrored keywords: the analysed column and the type of each channel.
MIRROR_CHANNELS = {
    "keywords": "HAS_KEYWORD",
    "classes": "HAS_CLASS",
    "functions": "HAS_FUNCTION",
    "imports_internal": "HAS_IMPORT_INTERNAL",
    "imports_external": "HAS_IMPORT_EXTERNAL",
    "ontology_concepts": "HAS_ONTOLOGY_CONCEPT",
    "business_entities": "HAS_BUSINESS_ENTITY",
    "system_capabilities": "HAS_SYSTEM_CAPABILITY",
    "side_effects": "HAS_SIDE_EFFECT",
    "config_dependencies": "HAS_CONFIG_DEPENDENCY",
    "integration_surface": "HAS_INTEGRATION_SURFACE",
    "contracts_provided": "PROVIDES_CONTRACT",
    "contracts_consumed": "CONSUMES_CONTRACT",
    "data_flow_direction": "HAS_DATA_FLOW_DIRECTION",
}
# White space that is trimmed from names.
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

# Operating limits.
MAX_FILE_BYTES, MAX_LINES, CONTEXT_TOKENS, CHUNK_TOKENS, PAGE_CHARS = 52_428_800, 2_000, 15_000, 6_000, 20_000

# Categories of ignore patterns.
PATTERN_CATEGORIES = ("directories", "filenames", "extensions", "globs")
# Sections of enrichment texts: title, column, and for which focus; shared is both.
SECTIONS = (
    ("TOP REPOSITORY KEYWORDS (by frequency)", "top_keywords", "product"),
    ("TOP BUSINESS ENTITIES", "top_business_entities", "product"),
    ("TOP ONTOLOGY CONCEPTS", "top_ontology_concepts", "product"),
    ("MAJOR SUBSYSTEMS", "major_subsystems", "product"),
    ("REPOSITORY ARCHITECTURE", "repo_architecture", "technical"),
    ("DATA FLOW", "repo_data_flow", "technical"),
    ("KEY PATTERNS", "repo_key_patterns", "technical"),
    ("INTEGRATION SURFACE", "integration_surface", "technical"),
    ("CONTRACTS PROVIDED", "contracts_provided", "technical"),
    ("CONTRACTS CONSUMED", "contracts_consumed", "technical"),
    ("SIDE EFFECTS", "side_effects", "technical"),
    ("CONFIG DEPENDENCIES", "config_dependencies", "technical"),
    ("SYSTEM CAPABILITIES", "top_system_capabilities", "technical"),
)
# Characters of a content that a verdict is asked on; outcomes of a scan.
VERDICT_CHARS = 4_000
OUTCOMES = ("accept", "accept-llm", "reject-static", "reject-llm", "oversized", "binary")

# Progress floors by phase; the file analysis spans 5 to 70.
PHASE_FLOOR = {"clone": 1, "scan": 3, "file_analysis": 5, "folder_analysis": 72, "indexing": 82, "enrichment": 92, "spec_generation": 95}

# Domain enumerations.
CONCEPT_KINDS = ("ontology", "business", "capability", "role", "pattern", "domain")
CONTRACT_KINDS = ("interface", "schema", "event", "config")
GUIDEPOST_KINDS = ("anomaly", "convention", "history", "warning", "starting-point")
EDGE_KINDS = {"concept": ("HAS_CONCEPT", "PLAYS_ROLE", "BELONGS_TO_DOMAIN"), "contract": ("DEFINES", "CONSUMES")}
# States of a knowledge base that may follow each, None being the begin: this library's own rule.
TRANSITIONS = {
    None: ("CREATED", "QUEUED"),
    "CREATED": ("QUEUED", "PROCESSING", "FAILED"),
    "QUEUED": ("PROCESSING", "HALTED", "FAILED", "CORRUPTED"),
    "PROCESSING": ("INGESTED", "PROCESSED", "HALTED", "FAILED", "CORRUPTED"),
    "INGESTED": ("PROCESSING", "PROCESSED", "HALTED", "FAILED"),
    "PROCESSED": ("QUEUED", "PROCESSING", "CORRUPTED"),
    "HALTED": ("QUEUED", "PROCESSING", "FAILED"),
    "FAILED": ("QUEUED",),
    "CORRUPTED": ("QUEUED",),
}
# Lengths and counts of enrichment.
NAME_CHARS, RATIONALE_CHARS, NOTE_CHARS = 120, 500, 800
MOST_CONCEPTS, MOST_CONTRACTS, MOST_GUIDEPOSTS = 20, 20, 10

# Patterns.
FULLTEXT_SPECIALS = r"""[+\-&|!(){}\[\]^"~*?:\\/]"""
SLUG = r"^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?\z"
COMMIT_HASH, BRANCH_NAME = r"^[0-9a-f]{40}\z", r"^[\w./-]+\z"
REPO_URL = r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+?)(?:\.git)?(?:/tree/([^?#]+))?/*\z"

# Failures that are tried again, and how.
RETRYABLE = ("llm_rate_limit", "llm_unreachable", "internal")
ATTEMPTS, BACK_OFF_S, LEASE_S, HEARTBEAT_S = 3, 5, 300, 60

# Limits of answers.
RESPONSE_CHARS, LEAST_RESULTS, TRIM = 32_000, 5, 0.7
BRANCHES_FOUND, BRANCHES_SHOWN, COMMITS_DEFAULT, COMMITS_MAX, SECTION_TOKENS = 10, 20, 200, 2_000, 15_000
