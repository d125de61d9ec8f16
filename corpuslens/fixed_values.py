"""Word lists, lookup tables, thresholds, formats and messages.

Everything in this module is data that results depend on literally.  It is kept
in one place, as plain text and in natural order; no logic lives here.
"""

# --- fixed values: file extension -> language (53 entries) -----------------
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c/cpp header",
    ".hpp": "c++ header",
    ".cs": "csharp",
    ".go": "go",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".r": "r",
    ".scala": "scala",
    ".pl": "perl",
    ".sh": "bash",
    ".ps1": "powershell",
    ".sql": "sql",
    ".html": "html",
    ".css": "css",
    ".jsx": "jsx",
    ".tsx": "tsx",
    ".vue": "vue",
    ".rs": "rust",
    ".m": "objective-c",
    ".mm": "objective-c++",
    ".groovy": "groovy",
    ".dart": "dart",
    ".lua": "lua",
    ".clj": "clojure",
    ".ex": "elixir",
    ".exs": "elixir",
    ".erl": "erlang",
    ".hrl": "erlang",
    ".hs": "haskell",
    ".fs": "f#",
    ".fsx": "f#",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".json": "json",
    ".xml": "xml",
    ".config": "config",
    ".md": "markdown",
    ".rst": "restructuredtext",
    ".toml": "toml",
    ".ini": "ini",
    ".bat": "batch",
    ".cmd": "batch",
    ".dockerfile": "dockerfile",
    ".tf": "terraform",
    ".hcl": "hcl",
}

# --- fixed values: frameworks searched for, by language, in report order ---
FRAMEWORKS = {
    "python": [
        "django", "flask", "fastapi", "pyramid", "tornado", "bottle", "cherrypy",
        "numpy", "pandas", "scikit-learn", "tensorflow", "pytorch", "keras",
        "matplotlib", "seaborn", "plotly", "dash", "streamlit", "gradio",
        "sqlalchemy", "django-orm", "pony", "peewee", "celery", "rq", "dramatiq",
        "pytest", "unittest", "nose", "behave", "robot", "selenium", "requests",
        "beautifulsoup", "scrapy", "lxml", "pydantic", "marshmallow", "dataclasses",
    ],
    "javascript": [
        "react", "angular", "vue", "svelte", "next.js", "nuxt.js", "gatsby",
        "express", "koa", "hapi", "nest.js", "meteor", "sails", "loopback",
        "jquery", "d3", "three.js", "chart.js", "highcharts", "echarts",
        "redux", "mobx", "vuex", "pinia", "recoil", "jotai", "zustand",
        "jest", "mocha", "jasmine", "karma", "cypress", "puppeteer", "playwright",
        "axios", "fetch", "graphql", "apollo", "relay", "swr", "react-query",
        "webpack", "rollup", "parcel", "vite", "esbuild", "babel", "typescript",
    ],
}

# --- fixed values: special file names and content marks of a language ------
MAKEFILE_NAMES = ["makefile", "gnumakefile", "makefile.am", "makefile.in"]
IGNORE_NAMES = [".gitignore", ".dockerignore"]
# interpreter word in the shebang line -> language, first hit wins
SHEBANG_LANGUAGES = [
    ("python", "python"),
    ("node", "javascript"),
    ("sh", "bash"),
    ("perl", "perl"),
    ("ruby", "ruby"),
]
CONTENT_PROBE_CHARS = 1000

# --- fixed values: key files of a project ----------------------------------
KEY_FILE_NAMES = [
    "main.py", "app.py", "index.js", "server.js", "application.java",
    "Program.cs", "Main.java", "App.js", "App.tsx", "index.html",
    "requirements.txt", "package.json", "setup.py", "pom.xml",
    "build.gradle", ".env", "config.json", "settings.py", "webpack.config.js",
]
KEY_FILE_WORDS = ["main", "app", "index", "server", "application", "config"]
KEY_FILE_GATE = 10        # a later tier is used only while fewer than this were found
KEY_FILE_LIMIT = 20
KEY_FILE_MIN_CHARS = 1000
LISTED_FILES = 100
PROMPT_KEY_FILES = 10
PROMPT_DEPENDENCIES = 20
TOP_LANGUAGES = 5

# --- fixed values: dependency patterns (Java regex dialect) ----------------
PYTHON_IMPORT_PATTERN = r"(?U:import\s+)([a-zA-Z0-9_.]+)"
PYTHON_FROM_PATTERN = r"(?U:from\s+)([a-zA-Z0-9_.]+)(?U:\s+)import"
PYTHON_STD_MODULES = ["__future__", "typing", "os", "sys", "re", "json", "time", "datetime"]
JS_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]
JS_IMPORT_PATTERN = r"(?d)import.*?from(?U:\s+)['\"]([^.][^'\"]+)['\"]"
JS_REQUIRE_PATTERN = r"require\(['\"]([^.][^'\"]+)['\"]\)"

# --- fixed values: entity rules over syntax nodes --------------------------
SQL_WORDS = [
    "SELECT", "FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY",
    "CREATE TABLE", "INSERT INTO", "UPDATE", "DELETE FROM",
]
DATAFRAME_METHODS = [
    "groupby", "filter", "sort_values", "merge", "join", "concat", "apply",
    "map", "pivot", "melt",
]
# inside a function body only the first seven count
FUNCTION_DATAFRAME_METHODS = [
    "groupby", "filter", "sort_values", "merge", "join", "concat", "apply",
]
FILE_PATH_MARKS = ["/", "\\", ".csv", ".xlsx", ".txt"]
OLDER_FILE_PATH_MARKS = ["/", "\\"]
CONFIG_WORDS = ["TABLE", "CONFIG", "PARAM", "SETTING"]
OLDER_CONFIG_WORDS = ["TABLE"]
SQL_CALL_METHODS = ["sql", "execute", "query"]
OLDER_SQL_CALL_METHODS = ["sql"]
RULE_CALL_WORDS = ["validate", "check", "enforce", "calculate", "compute", "apply_rule"]

# --- fixed values: graph labels --------------------------------------------
LABEL_MAX = 20
LABEL_KEEP = 17
LABEL_TAIL = "..."

# --- fixed values: debt and issue thresholds -------------------------------
DEBT_LONG_FUNCTION_LINES = 30
DEBT_STEP = 20.0
DEBT_COMMENT_RATIO = 0.1
DEBT_COMPLEXITY_RATIO = 0.1
DEBT_DOCSTRING_PERCENT = 50
PARSE_ERROR_MESSAGE = "Failed to parse Python code"

# --- fixed values: issue rules ---------------------------------------------
# rule, rank, severity, category, threshold, message format, recommendation
ISSUE_RULES = {
    "syntax": (
        1, "HIGH", "Syntax", None, PARSE_ERROR_MESSAGE,
        "Fix the syntax errors in the file to enable proper analysis.",
    ),
    "long_function": (
        2, "MEDIUM", "Maintainability", 50, "Function '%s' is too long (%d lines)",
        "Consider breaking this function into smaller, more focused functions.",
    ),
    "too_many_args": (
        3, "MEDIUM", "Design", 5, "Function '%s' has too many arguments (%d)",
        "Consider grouping related parameters into a class or using keyword arguments.",
    ),
    "missing_docstring": (
        4, "LOW", "Documentation", None, "Missing docstring in %s '%s'",
        "Add a docstring to describe what this %s does.",
    ),
    "too_complex": (
        5, "HIGH", "Complexity", 10, "Function '%s' is too complex (complexity: %d)",
        "Refactor this function to reduce its complexity by extracting logic into helper functions.",
    ),
    "empty_except": (
        6, "HIGH", "Error Handling", None, "Empty except block",
        "Empty except blocks hide errors. Either handle the exception properly or log it.",
    ),
    "mutable_default": (
        6, "MEDIUM", "Bug Risk", None, "Mutable default argument in function '%s'",
        "Using mutable objects as default arguments can lead to unexpected behavior. Use None instead.",
    ),
}

# --- fixed values: sections of a plain-text answer -------------------------
SECTION_HEADERS = [
    "code quality", "variables", "functions", "classes",
    "external communications", "data transformations",
    "architecture", "security", "summary", "conclusion",
    "recommendation", "strength", "weakness", "api",
]
NO_SUMMARY = "No summary available."
NO_SUMMARY_EXPORT = "No summary available"
UNKNOWN_FILE = "Unknown"

# --- fixed values: transformation kind by words of its description ---------
TRANSFORMATION_KINDS = [
    ("filter", ["filter", "where"]),
    ("map", ["map", "convert", "transform"]),
    ("reduce", ["reduce", "aggregate", "sum"]),
    ("sort", ["sort", "order"]),
    ("join", ["join", "merge"]),
    ("group", ["group"]),
]

# --- fixed values: default project structure -------------------------------
DEFAULT_PROJECT = {
    "project_type": "Unknown",
    "architecture": "Could not determine",
    "purpose": "Could not determine the overall purpose of the codebase.",
    "unknown": "Unknown",
    "summary": "Analysis could not be completed in structured format. Please see raw response.",
}

# --- fixed values: prompt texts --------------------------------------------
EXPLAIN_PROMPTS = {
    "sql": "Explain this SQL logic in simple terms for business understanding: ",
    "transformation": "Explain this data transformation in simple terms for business understanding: ",
    "business_rule": "Explain this business rule in simple terms for non-technical stakeholders: ",
    "other": "Explain this code logic in simple terms for business understanding: ",
}

FILE_PROMPT_HEAD = """
Please analyze the following {language} code from file '{filename}':

```{language}
{content}
```
"""

FILE_PROMPT_TAIL = """
Provide a comprehensive analysis in JSON format with the following structure:
{
    "code_quality": {
        "score": <0-100 score>,
        "strengths": [<list of code strengths>],
        "weaknesses": [<list of code weaknesses>]
    },
    "variables": {
        "important_variables": [
            {
                "name": "<variable name>",
                "type": "<variable type if detectable>",
                "purpose": "<brief description of the variable's purpose>",
                "transformations": [<list of transformations applied to this variable>]
            }
        ]
    },
    "functions": {
        "count": <number of functions/methods>,
        "important_functions": [
            {
                "name": "<function name>",
                "purpose": "<brief description of what the function does>",
                "parameters": [<list of parameters>],
                "return_value": "<description of what the function returns>"
            }
        ]
    },
    "classes": {
        "count": <number of classes>,
        "important_classes": [
            {
                "name": "<class name>",
                "purpose": "<brief description of the class's purpose>",
                "properties": [<list of important properties>],
                "methods": [<list of important methods>]
            }
        ]
    },
    "external_communications": {
        "apis": [
            {
                "name": "<API name or endpoint>",
                "purpose": "<what this API is used for>",
                "method": "<HTTP method if applicable>"
            }
        ],
        "databases": [
            {
                "type": "<database type>",
                "operations": [<list of operations performed>]
            }
        ],
        "file_operations": [<list of file operations performed>]
    },
    "data_transformations": [
        {
            "description": "<description of data transformation>",
            "input": "<input data format or source>",
            "output": "<output data format or destination>"
        }
    ],
    "architecture": {
        "patterns": [<identified design patterns>],
        "anti_patterns": [<identified anti-patterns>],
        "suggestions": [<architectural improvement suggestions>]
    },
    "security": {
        "vulnerabilities": [<potential security issues>],
        "severity": <"low", "medium", or "high">,
        "mitigations": [<security improvement suggestions>]
    },
    "summary": "<overall assessment in 2-3 sentences>"
}

Focus on providing actionable insights and specific information about variables, transformations, and external communications. If a section is not applicable, include an empty list or appropriate default values.
"""

PROJECT_PROMPT_HEAD = """
Analyze the structure of this project based on the file list and key information below:

File List (showing {shown} of {total} files):
{files}

Language Distribution:
{languages}

Key Files:
{key_files}

Detected Dependencies:
{dependencies}
"""

PROJECT_PROMPT_TAIL = """
Based on this information, provide a comprehensive analysis of the project structure in JSON format:
{
    "project_type": "<type of project (e.g., web application, API, library, etc.)>",
    "main_languages": [<list of main programming languages used>],
    "architecture": "<architectural pattern identified (e.g., MVC, microservices, etc.)>",
    "entry_points": [<likely entry points or main files>],
    "dependencies": [
        {
            "name": "<dependency name>",
            "purpose": "<what this dependency is used for>",
            "type": "<framework, library, tool, etc.>"
        }
    ],
    "code_lineage": {
        "purpose": "<overall purpose of the codebase>",
        "history": "<likely evolution of the codebase>",
        "organization": "<how the code is organized>",
        "complexity": "<assessment of codebase complexity>"
    },
    "technical_stack": {
        "frontend": [<frontend technologies>],
        "backend": [<backend technologies>],
        "database": [<database technologies>],
        "infrastructure": [<infrastructure technologies>]
    },
    "data_flow": {
        "sources": [<data sources>],
        "transformations": [<key data transformations>],
        "sinks": [<data destinations>]
    },
    "key_components": [
        {
            "name": "<component name>",
            "purpose": "<component purpose>",
            "files": [<files that make up this component>]
        }
    ],
    "legacy_aspects": [<list of legacy code patterns or technologies>],
    "modernization_opportunities": [<suggestions for modernizing the codebase>],
    "summary": "<overall assessment of the project structure>"
}

Focus on providing accurate insights about the project's structure, purpose, technical stack, and lineage. If you're uncertain about any aspect, provide your best assessment based on the available information.
"""
