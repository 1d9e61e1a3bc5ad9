"""What a file is, from its path: text or binary, plan group, archive group, language, layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import paths

# Extensions and names that tell text from binary files.
TEXT_EXTENSIONS = [
    "adoc", "ahk", "asciidoc", "astro", "bash", "bat", "bib", "bzl", "c", "cc", "cfg", "cjs", "clj", "cljc", "cljs", "cls", "cmake", "cmd", "conf", "config", "cpp", "cs", "css", "csv", "cxx", "d", "dart",
    "desktop", "diff", "dockerfile", "dockerignore", "editorconfig", "edn", "ejs", "elm", "env", "erl", "err", "ex", "exs", "feature", "fish", "fs", "fsi", "fsx", "gemspec", "gitattributes", "gitignore", "go",
    "gql", "gradle", "graphql", "groovy", "h", "haml", "hcl", "hh", "hpp", "hrl", "hs", "htm", "html", "hxx", "ini", "ipynb", "java", "jl", "js", "json", "json5", "jsx", "kt", "kts", "less", "lhs", "lock",
    "log", "lua", "makefile", "md", "markdown", "mjs", "mk", "ml", "mli", "nim", "npmrc", "nvmrc", "odin", "org", "out", "patch", "php", "phtml", "pl", "pm", "pod", "properties", "proto", "ps1", "psm1", "py",
    "pyi", "pyw", "r", "rake", "rb", "rs", "rst", "sass", "scala", "scss", "sh", "sol", "sql", "svelte", "tex", "tf", "tfvars", "toml", "ts", "tsv", "tsx", "txt", "v", "vb", "vbs", "vue", "xml", "yaml", "yml",
    "zig", "zsh", "s", "asm", "dts", "dtsi", "dtso", "lds", "ld", "ac", "am", "m4", "in", "mak", "make", "kconfig", "defconfig", "cocci", "awk", "sed",
]
BINARY_EXTENSIONS = [
    "7z", "a", "aac", "accdb", "ai", "aiff", "apk", "avi", "bin", "blend", "bmp", "bz2", "cab", "class", "db", "dll", "dmg", "doc", "docx", "dwg", "dylib", "ear", "eot", "epub", "exe", "fbx", "flac", "flv",
    "gif", "gz", "heic", "ico", "iso", "jar", "jpeg", "jpg", "lib", "m4a", "m4v", "max", "mdb", "mkv", "mov", "mp3", "mp4", "mpeg", "mpg", "o", "obj", "odp", "ods", "odt", "ogg", "opus", "otf", "pdf", "png",
    "ppt", "pptx", "psd", "pyc", "pyd", "pyo", "rar", "raw", "so", "sqlite", "sqlite3", "tar", "tif", "tiff", "ttf", "wav", "war", "webm", "webp", "wmv", "woff", "woff2", "wma", "xls", "xlsx", "xz", "zip",
]
TEXT_NAMES = [
    ".env", ".env.example", ".env.local", ".env.development", ".env.production", ".gitignore", ".gitattributes", ".dockerignore", ".editorconfig", ".npmrc", ".nvmrc", "dockerfile", "makefile", "readme",
    "license", "kconfig", "kbuild", "gnumakefile", "maintainers", "copying", "authors", "credits",
]

# Groups of a plan, by extension; names and tests are looked at first.
PLAN_GROUPS = {
    "python_source": "py pyw pyi",
    "frontend_source": "js jsx ts tsx css scss html vue svelte",
    "backend_or_system_source": "go rs java kt cs c cpp h hpp",
    "docs": "md rst adoc txt",
    "config_and_locks": "json yaml yml toml ini cfg conf lock",
    "assets_and_binary_docs": "png jpg jpeg webp gif svg ico pdf docx xlsx pptx",
    "data_and_exports": "db sqlite sqlite3 csv tsv sql dump bak",
}
# Groups of an archive, by extension.
ARCHIVE_GROUPS = {
    "30_docs": "md rst adoc txt",
    "40_python_source": "py pyw pyi",
    "41_frontend_source": "js jsx ts tsx mjs cjs css scss sass html vue svelte astro",
    "42_backend_or_system_source": "go rs java kt kts cs cpp c h hpp rb php",
    "50_config_and_locks": "json yaml yml toml ini cfg conf lock dockerfile",
    "60_assets_and_binary_docs": "png jpg jpeg gif webp svg ico pdf docx xlsx pptx",
    "70_data_and_exports": "csv tsv sql xml",
}
# Languages by extension and by file name.
LANGUAGES = {
    "py": "Python", "pyw": "Python", "pyi": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript / React", "ts": "TypeScript", "tsx": "TypeScript / React", "css": "CSS",
    "scss": "SCSS", "sass": "Sass", "less": "Less", "html": "HTML", "htm": "HTML", "vue": "Vue", "svelte": "Svelte", "astro": "Astro", "go": "Go", "rs": "Rust", "java": "Java", "kt": "Kotlin", "kts": "Kotlin",
    "cs": "C#", "cpp": "C++", "cxx": "C++", "cc": "C++", "c": "C", "h": "C/C++ Header", "hpp": "C++ Header", "rb": "Ruby", "php": "PHP", "swift": "Swift", "dart": "Dart", "sql": "SQL", "sh": "Shell",
    "bash": "Shell", "zsh": "Shell", "fish": "Shell", "ps1": "PowerShell", "bat": "Batch", "cmd": "Batch", "json": "JSON", "json5": "JSON5", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "xml": "XML",
    "md": "Markdown", "markdown": "Markdown", "rst": "reStructuredText", "dockerfile": "Dockerfile", "s": "Assembly", "asm": "Assembly", "lds": "Linker Script", "ld": "Linker Script", "dts": "Device Tree",
    "dtsi": "Device Tree", "dtso": "Device Tree", "mk": "Makefile", "mak": "Makefile", "make": "Makefile", "cmake": "CMake", "ac": "Autoconf", "am": "Automake", "m4": "M4", "pl": "Perl", "pm": "Perl",
    "awk": "Awk", "cocci": "Coccinelle",
}
LANGUAGE_NAMES = {
    "makefile": "Makefile", "gnumakefile": "Makefile", "kbuild": "Makefile", "kconfig": "Kconfig", "dockerfile": "Dockerfile", "vagrantfile": "Ruby", "rakefile": "Ruby", "gemfile": "Ruby", "justfile": "Just",
    "cmakelists.txt": "CMake", "meson.build": "Meson",
}


def by_extension(groups: dict[str, str]) -> dict[str, str]:
    return {e: group for group, extensions in groups.items() for e in extensions.split()}


def named(value: Column, names: dict[str, str]) -> Column:
    """What names has for value, null if nothing; a constant map, so rows stay where they are."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)


def lookup(value: Column, groups: dict[str, str]) -> Column:
    """The group that value belongs to, null if none."""
    return named(value, by_extension(groups))


def is_text(path: Column) -> Column:
    """A known name is text, then a binary extension isn't, then a text extension is; all else isn't."""
    n, e = F.lower(paths.name(path)), paths.extension(path)
    return F.when(n.isin(TEXT_NAMES), True).when(e.isin(BINARY_EXTENSIONS), False).otherwise(e.isin(TEXT_EXTENSIONS))


def plan_group(path: Column) -> Column:
    n, e = F.lower(paths.name(path)), paths.extension(path)
    tests = F.exists(paths.parts(F.lower(path)), lambda p: p.isin("test", "tests", "__tests__")) | n.startswith("test_")
    group = lookup(e, PLAN_GROUPS)
    early = group.isin("python_source", "frontend_source", "backend_or_system_source", "docs")
    return F.when(tests, "tests").when(early, group).when(n.isin("readme.md", "license"), "docs").when((group == "config_and_locks") | n.startswith("dockerfile"), "config_and_locks").otherwise(F.coalesce(group, F.lit("other")))


def archive_group(path: Column, project: Column) -> Column:
    p, n, e = paths.parts(F.lower(path)), F.lower(paths.name(path)), paths.extension(path)
    top, group = F.try_element_at(p, F.lit(1)), lookup(e, ARCHIVE_GROUPS)
    early = group.isin("40_python_source", "41_frontend_source", "42_backend_or_system_source")
    return (
        F.when(F.coalesce(top, F.lit("")).isin("", "index.md", "manifest.json", "project_profile.json"), "00_metadata")
        .when((top == "reports") & F.array_contains(p, "ai_context"), "02_ai_context")
        .when((top == "reports") & F.array_contains(p, "ai_prompts"), "03_ai_prompts")
        .when(top == "reports", "01_reports")
        .when(F.arrays_overlap(p, F.array(*map(F.lit, ("test", "tests", "__tests__", "spec")))), "20_tests")
        .when(n.isin("readme.md", "license", "changelog.md") | (group == "30_docs"), "30_docs")
        .when(early, group)
        .when((group == "50_config_and_locks") | n.startswith("dockerfile"), "50_config_and_locks")
        .when(group.isNotNull(), group)
        .when(top == F.lower(project), "80_other_project_files")
        .otherwise("90_other")
    )


def language(path: Column) -> Column:
    """By file name, then extension, then the name before its first dot; null if unknown."""
    n = F.lower(paths.name(path))
    stem = named(F.substring_index(n, ".", 1), LANGUAGE_NAMES)
    return F.coalesce(named(n, LANGUAGE_NAMES), named(paths.extension_key(path), LANGUAGES), F.when(n.contains("."), stem))


def is_binary_sniff(content: Column) -> Column:
    """Whether the first 8192 bytes hold a NUL, or over 30 % control bytes (under 9, or 14 to 31)."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    controls = F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1F]"))
    return head.contains("\x00") | F.coalesce(controls / F.nullif(F.length(head), F.lit(0)) > 0.30, F.lit(False))
