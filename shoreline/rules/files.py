"""Fixed values about file names, languages and feeds."""

# --- fixed values -----------------------------------------------------------

TEST_SUFFIXES = [
    "_test.go", "_test.py", ".test.js", ".test.ts", ".test.tsx", ".test.jsx",
    ".spec.js", ".spec.ts", ".spec.tsx",
]
TEST_DIRS = ["test", "tests", "__tests__", "testdata", "test_fixtures", "testutil"]
GENERATED_SUFFIXES = [
    ".pb.go", ".pb.cc", ".pb.h", "_generated.go", ".generated.go",
    ".generated.ts", "_generated.ts",
]
GENERATED_PREFIXES = ["mock_", "zz_generated"]
GENERATED_DIRS = ["generated", "gen", "__generated__", "autogen"]

LANGUAGE_EXTENSIONS = {
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++", ".inl"],
    "go": [".go", ".mod", ".sum"],
    "java": [".java", ".kt", ".kts", ".gradle", ".gradle.kts", ".xml"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala", ".sbt"],
    "python": [".py", ".pyi", ".pyw"],
    "ruby": [".rb", ".rake", ".gemspec"],
    "rust": [".rs", ".toml"],
    "javascript": [".js", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "swift": [".swift"],
    "objc": [".m", ".mm"],
    "php": [".php", ".php3", ".php4", ".php5", ".phtml"],
    "csharp": [".cs", ".csx", ".csproj", ".fsproj", ".vbproj", ".sln"],
    "dotnet": [".cs", ".csx", ".vb", ".fs", ".csproj", ".fsproj", ".vbproj", ".sln"],
    "yaml": [".yaml", ".yml"],
    "json": [".json"],
    "properties": [".properties"],
    "env": [],
    "toml": [".toml"],
    "xml": [".xml", ".config"],
    "ini": [".ini", ".cfg", ".cnf"],
    "hcl": [".tf", ".hcl", ".tfvars"],
}
# A feed that reads whole artifacts takes every file.
ANY_FILE = "(artifacts)"

CONFIG_NAMES = [
    "application.yml", "application.yaml", "application.json", "application.properties",
    "application-prod.yml", "application-prod.yaml", "application-dev.yml",
    "application-dev.yaml", "application-test.yml", "application-test.yaml",
    "application-staging.yml", "application-staging.yaml",
    "config.yml", "config.yaml", "config.json", "config.toml", "settings.toml",
    "cargo.toml", "pyproject.toml", "netlify.toml", "hugo.toml",
    ".env", ".env.local", ".env.production", ".env.development", ".env.test", ".env.staging",
    "appsettings.json", "appsettings.development.json", "appsettings.production.json",
    "web.config", "crypto.properties", "security.properties", "ssl.properties",
    "tls.properties", "cipher.properties", "keystore.properties",
    "web.xml", "pom.xml", "applicationcontext.xml", "server.xml", "struts.xml",
    "hibernate.cfg.xml", "persistence.xml", "log4j2.xml", "beans.xml",
    "php.ini", "my.cnf", "my.ini", "openssl.cnf", "openssl.cfg", "setup.cfg", "tox.ini",
    "pytest.ini", "main.tf", "variables.tf", "outputs.tf", "provider.tf", "backend.tf",
    "terraform.tfvars",
]
CONFIG_EXTENSIONS = [
    ".yml", ".yaml", ".json", ".properties", ".toml", ".xml", ".config",
    ".ini", ".cfg", ".cnf", ".tf", ".hcl", ".tfvars",
]
CONFIG_DIR_WORDS = ["config", "conf", "resources", "settings"]
CONFIG_FILE_WORDS = [
    "config", "crypto", "security", "ssl", "tls", "encrypt", "cipher", "keystore", "truststore",
]

SKIPPED_DIRS = ["vendor", "node_modules", ".git"]

# Feeds in registration order: name, tier (1 pattern, 2 flow, 3 supply chain,
# 4 binary, 5 network).
FEEDS = [
    ("cipherscope", 1), ("cryptoscan", 1), ("astgrep", 1), ("semgrep", 2),
    ("cryptodeps", 3), ("cdxgen", 3), ("syft", 3), ("cbomkit-theia", 3),
    ("binary-scanner", 4), ("config-scanner", 1),
    ("tls-probe", 5), ("ct-lookup", 5), ("ssh-probe", 5), ("zeek-log", 5), ("suricata-log", 5),
]

# Manifest a package URL type comes from.
PURL_MANIFESTS = {
    "npm": "package.json", "maven": "pom.xml", "golang": "go.mod",
    "pypi": "requirements.txt", "gem": "Gemfile", "cargo": "Cargo.toml",
    "composer": "composer.json", "swift": "Package.swift",
}

# Language a file extension stands for, when choosing a migration example.
SNIPPET_LANGUAGES = {
    "go": [".go"], "python": [".py"], "java": [".java"], "rust": [".rs"],
    "javascript": [".js"], "typescript": [".ts", ".tsx"], "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"], "csharp": [".cs"], "swift": [".swift"],
    "config": [".yml", ".yaml", ".conf", ".nginx", ".cnf", ".cfg", ".properties", ".toml",
               ".json", ".xml", ".ini", ".hcl", ".env"],
}
SERVER_DIRS = ["nginx", "apache", "apache2", "httpd", "haproxy", "ssh"]
