"""Words, lists, limits and patterns that results depend on."""

# Files that a scan leaves out.
IGNORED_FOLDERS = (".git", "bin", "build", "docs", "input", "node_modules", ".vscode", "dist", "output", "tests")
IGNORED_PREFIX = "test-"
IGNORED_NAMES = ("package-lock.json", ".gitignore", ".npmrc", ".nvmrc")
MINIFIED_SUFFIXES = (".min.js", ".min.cjs", ".min.mjs", ".min.css")
GENERATED_SUFFIXES = (".generated.ts", ".generated.js", ".generated.css", ".g.ts", ".g.dart", "_pb.ts", "_pb.js", "_pb2.py", ".pb.go")
GENERATED_MARKERS = ("DO NOT EDIT", "do not edit", "AUTO-GENERATED", "auto-generated", "Auto-generated", "automatically generated", "THIS FILE IS GENERATED", "Code generated by", "@generated")
MARKER_CHARS = 1024
BINARY_EXTENSIONS = tuple(
    "aac abw arc avif avi azw bin bmp bz bz2 cda doc docx eot epub gz gif ico ics jar jpeg jpg mid midi mp3 mp4 mpeg mpkg odp ods odt oga ogv ogx opus otf png pdf ppt pptx rar rtf svg tar tif tiff ttf vsd wav weba webm webp woff woff2 xls xlsx xul zip 3gp 3g2 7z ear war tgz".split()
)

# File types by extension: type, extensions, and whether they are code.
EXTENSION_TYPES = (
    ("java", "java kt kts scala groovy", True),
    ("javascript", "js mjs cjs jsx ts tsx", True),
    ("python", "py", True),
    ("ruby", "rb", True),
    ("csharp", "cs csx", True),
    ("c", "c h", True),
    ("cpp", "cpp cxx cc hpp hh hxx", True),
    ("sql", "sql ddl dml pkb pks pck fnc prc trg", True),
    ("shell-script", "sh bash", True),
    ("batch-script", "bat cmd", True),
    ("jcl", "jcl", True),
    ("xml", "xml", True),
    ("jsp", "jsp", True),
    ("default", "go rs swift php r dart lua pl pm tcl vb vbs fs fsi fsx clj cljs cljc edn ex exs elm erl hrl hs", True),
    ("markdown", "md markdown", False),
    ("dotnet-proj", "csproj vbproj fsproj", False),
    ("default", "html htm txt rst adoc", False),
)
EXTENSION_ALIASES = {"javascript": "javascript", "typescript": "javascript", "ruby": "ruby", "csharp": "csharp"}
FILENAME_TYPES = {
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "build.xml": "ant", "package.json": "npm", "package-lock.json": "npm", "yarn.lock": "npm", "packages.config": "nuget",
    "requirements.txt": "python-pip", "setup.py": "python-setup", "pyproject.toml": "python-poetry", "pipfile": "python-pip", "pipfile.lock": "python-pip", "gemfile": "ruby-bundler", "gemfile.lock": "ruby-bundler",
    "crontab": "shell-script", "cmakelists.txt": "makefile", "makefile": "makefile", "gnumakefile": "makefile", "configure.ac": "makefile", "configure.in": "makefile",
}
#: Name alone, or followed by a dot; for makefile only the latter.
NAME_PREFIX_TYPES = (("readme", "markdown", True), ("license", "markdown", True), ("changelog", "markdown", True), ("makefile", "makefile", False))
CANONICAL_TYPES = tuple("java javascript sql xml jsp markdown csharp ruby maven gradle ant npm python dotnet-proj nuget ruby-bundler python-pip python-setup python-poetry shell-script batch-script jcl c cpp makefile default".split())
DEPENDENCY_TYPES = ("maven", "gradle", "ant", "npm", "dotnet-proj", "nuget", "ruby-bundler", "python-pip", "python-setup", "python-poetry")
JOB_TYPES = ("shell-script", "batch-script", "jcl")

# Enumerations of summaries.
INVALID = "INVALID"
DATABASE_MECHANISMS = ("NONE", "JDBC", "SPRING-DATA", "HIBERNATE", "JPA", "EJB", "EF-CORE", "ADO-NET", "DAPPER", "ACTIVE-RECORD", "SEQUEL", "MONGOOSE", "PRISMA", "TYPEORM", "SEQUELIZE", "KNEX", "DRIZZLE", "SQLALCHEMY", "DJANGO-ORM", "GORM", "SQLX", "ROOM", "CORE-DATA", "MQL", "REDIS", "ELASTICSEARCH", "CASSANDRA-CQL", "SQL", "ORM", "MICRO-ORM", "DRIVER", "DDL", "DML", "STORED-PROCEDURE", "PLSQL-PACKAGE", "TRIGGER", "FUNCTION", "OTHER", "INVALID")
OPERATION_TYPES = ("READ", "WRITE", "READ_WRITE", "DDL", "ADMIN", "OTHER", "INVALID")
QUERY_PATTERNS = ("SIMPLE CRUD", "COMPLEX JOINS", "AGGREGATIONS", "STORED PROCEDURES", "BATCH OPERATIONS", "MIGRATIONS", "INLINE SQL", "ORM QUERIES", "RAW DRIVER CALLS", "CACHE LOOKUPS", "OTHER", "INVALID")
TRANSACTION_HANDLING = ("SPRING @TRANSACTIONAL", "MANUAL", "AUTO-COMMIT", "NONE", "JPA ENTITYTRANSACTION", "BATCH", "DB CONTEXT", "EXPLICIT BEGIN/COMMIT", "ROLLBACK ON ERROR", "UNKNOWN", "OTHER", "INVALID")
DIRECTIONS = ("PRODUCER", "CONSUMER", "BOTH", "BIDIRECTIONAL", "OTHER", "INVALID")
INTEGRATION_MECHANISMS = ("REST", "GRAPHQL", "GRPC", "SOAP", "WEBSOCKET", "TRPC", "JMS-QUEUE", "JMS-TOPIC", "KAFKA-TOPIC", "RABBITMQ-QUEUE", "RABBITMQ-EXCHANGE", "ACTIVEMQ-QUEUE", "ACTIVEMQ-TOPIC", "AWS-SQS", "AWS-SNS", "AZURE-SERVICE-BUS-QUEUE", "AZURE-SERVICE-BUS-TOPIC", "REDIS-PUBSUB", "WEBHOOK", "SSE", "OTHER", "INVALID")
CODE_SMELLS = ("LONG METHOD", "LONG PARAMETER LIST", "COMPLEX CONDITIONAL", "DUPLICATE CODE", "MAGIC NUMBERS", "DEEP NESTING", "DEAD CODE", "GOD CLASS", "LARGE CLASS", "DATA CLASS", "FEATURE ENVY", "SHOTGUN SURGERY", "OTHER", "INVALID")
FILE_SMELLS = ("GOD CLASS", "TOO MANY METHODS", "FEATURE ENVY", "DATA CLASS", "LARGE FILE", "OTHER", "INVALID")
ENTITY_KINDS = ("CLASS", "INTERFACE", "RECORD", "STRUCT", "ENUM", "ANNOTATION-TYPE", "MODULE", "UNION", "FUNCTION", "INVALID")
COMPLEXITIES = ("LOW", "MEDIUM", "HIGH", "INVALID")
STORED_OBJECTS = ("PROCEDURE", "FUNCTION")
LLM_STATUSES = ("SUCCESS", "FAILURE", "SWITCH", "OVERLOAD_RETRY", "HOPEFUL_RETRY", "CROP", "JSON_MUTATED")

# Levels.
COUPLING_LEVELS = ((0.7, "Very High"), (0.4, "High"), (0.2, "Medium"))
DEBT_LEVELS = ((20, "Very High"), (10, "High"), (5, "Moderate"))
LOWEST = "Low"
COUPLING_CLASSES = {"Very High": "badge-danger", "High": "badge-high", "Medium": "badge-warning", "Low": "badge-success"}
DEBT_CLASSES = {"Very High": "badge-danger", "High": "badge-warning", "Moderate": "badge-info", "Low": "badge-success"}
HIGH_COMPLEXITY, VERY_HIGH_COMPLEXITY, LONG_FUNCTION_LINES = 10, 20, 50
TOP_FUNCTIONS, TOP_FILES, TOP_SMELLS, HIGH_SCRIPTLETS = 10, 10, 15, 10
TAG_LIBRARIES = (("java.sun.com/jsp/jstl", "JSTL"), ("springframework.org", "Spring"), ("/WEB-INF/", "Custom"), ("custom", "Custom"))
OTHER_TAG_LIBRARY = "Other"

# Triggers of scheduled jobs: words, in order, and the type they stand for.
TRIGGER_WORDS = (("cron", "cron"), ("task scheduler", "task-scheduler"), ("schtasks", "task-scheduler"), ("task_scheduler", "task-scheduler"), ("schedule", "scheduled"), ("manual", "manual"), ("event", "event-driven"), ("systemd", "systemd-timer"), ("timer", "systemd-timer"))
UNKNOWN = "unknown"

SMELL_ADVICE = (
    ("long method", "Refactor into smaller, single-purpose methods"),
    ("god class", "Split into multiple classes following Single Responsibility Principle"),
    ("duplicate code", "Extract common code into reusable functions or utilities"),
    ("long parameter list", "Use parameter objects or builder pattern"),
    ("complex conditional", "Simplify conditionals or extract into guard clauses"),
)
SMELL_ADVICE_OTHERWISE = "Review and refactor as part of modernization effort"
NO_SCRIPTLETS = "No scriptlets detected - excellent! The codebase follows modern JSP best practices."
SCRIPTLET_ADVICE = (
    (5, "Low scriptlet usage (%.1f per file). Consider further refactoring to eliminate remaining scriptlets."),
    (10, "Moderate scriptlet usage (%.1f per file). Refactoring to tag libraries or modern UI framework recommended."),
    (None, "High scriptlet usage (%.1f per file). Significant refactoring needed for modernization."),
)

# Model calls.
CHARS_PER_TOKEN, BATCH_RATIO = 3.6, 0.7
COMPLETION_BUFFER, COMPLETION_RATIO, PROMPT_RATIO = 5, 0.75, 0.85
ATTEMPTS, LEAST_DELAY_S, MOST_DELAY_S, CONCURRENCY = 3, 10, 90, 50
SEARCH_RESULTS = 6
SEARCH_CANDIDATES = 150
#: By provider, in order: pattern (Java syntax), unit, and the groups of limit, prompt and completion (0: none).
ERROR_PATTERNS = {
    "bedrock": (
        (r"ax input tokens.*?(\d+).*?request input token count.*?(\d+)", "tokens", 1, 2, 0),
        (r"maxLength.*?(\d+).*?actual.*?(\d+)", "chars", 1, 2, 0),
        (r"maximum context length is ?(\d+) tokens", "tokens", 1, 0, 0),
        (r"Prompt contains (\d+) tokens.*?too large for model with (\d+) maximum context length", "tokens", 2, 1, 0),
    ),
    "openai": (
        (r"max.*?(\d+) tokens.*?\(.*?(\d+).*?prompt.*?(\d+).*?completion", "tokens", 1, 2, 3),
        (r"max.*?(\d+) tokens.*?(\d+) ", "tokens", 1, 2, 0),
    ),
    "vertex-claude": (
        (r"(?i)prompt is too long:\s*(\d+)\s*tokens\s*>\s*(\d+)\s*maximum", "tokens", 2, 1, 0),
        (r"(?i)exceeds.*?maximum.*?context.*?(?:length|tokens)?.*?(\d+).*?(\d+)|(?:\d+).*?context.*?(?:\d+)", "tokens", 2, 1, 0),
        (r"(?i)request.*?too large.*?(\d+).*?tokens.*?(\d+)", "tokens", 2, 1, 0),
    ),
    "vertex-gemini": ((r"input.*?token.*?count.*?\((\d+)\).*?exceeds.*?maximum.*?tokens.*?allowed.*?\((\d+)\)", "tokens", 2, 1, 0),),
}
MERMAID_ESCAPES = (('"', "#quot;"), ("<", "#lt;"), (">", "#gt;"), ("[", "#91;"), ("]", "#93;"), ("(", "#40;"), (")", "#41;"), ("{", "#123;"), ("}", "#125;"))
REDACTED, REDACTED_URL = "REDACTED", "REDACTED_URL"
