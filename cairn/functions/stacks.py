"""Values by which directories, build files and dependencies tell what a project is made of."""

from __future__ import annotations

# Layers of directories by the names of their parts; the first layer that is hit counts.
DIRECTORY_LAYERS = {
    "UI / presentation": ["ui", "views", "pages", "components", "widgets", "layouts", "screens"],
    "Application / orchestration": ["services", "application", "usecases", "use_cases", "handlers", "controllers"],
    "Domain / business logic": ["domain", "core", "models", "entities", "business"],
    "Data access / persistence": ["repositories", "repository", "dao", "db", "database", "migrations", "storage"],
    "API / transport": ["api", "routes", "routers", "endpoints", "http", "server"],
    "Configuration": ["config", "settings", "infra", "infrastructure"],
    "Tests": ["tests", "test", "spec", "__tests__"],
    "Utilities": ["utils", "helpers", "lib", "shared"],
}
# Roles of directories; each with the names of parts that give it. Of the first set only the first role counts.
PAGE_ROLES = {name: [name] for name in ["pages", "routes", "app", "features", "components", "widgets", "layouts"]}
FRONTEND_ROLES = {"pages": ["pages"], "routes": ["routes"], "components": ["components"], "hooks": ["hooks"], "stores": ["stores"], "styles": ["css", "styles", "style"]}
BACKEND_ROLES = {"api": ["api"], "services": ["services"], "models": ["models"], "repositories": ["repositories"], "migrations": ["migrations"], "workers": ["tasks", "jobs", "worker"], "config": ["config"]}

# Stacks with the names and suffixes at a project's root that show them, names that must be there as
# well, and directories to be ignored besides.
STACKS = [
    ("Node.js", ["package.json"], [], [], ["node_modules", ".pnp", ".npm", ".yarn", ".next", ".nuxt", ".expo", ".turbo", ".parcel-cache", "out"]),
    ("Python", ["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile"], [], [], [".venv", "venv", "env", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", "htmlcov", "*.egg-info"]),
    ("Go", ["go.mod"], [], [], ["vendor"]),
    ("Rust", ["Cargo.toml"], [], [], ["target"]),
    ("Java / Maven", ["pom.xml"], [], [], ["target", ".mvn"]),
    ("Java / Gradle", ["build.gradle", "settings.gradle", "build.gradle.kts"], [], [], ["build", ".gradle", ".idea"]),
    (".NET / C#", [], [".csproj", ".sln"], [], ["bin", "obj", ".vs"]),
    ("Flutter / Dart", ["pubspec.yaml"], [], [], [".dart_tool", "build", ".flutter-plugins"]),
    ("PHP / Composer", ["composer.json"], [], [], ["vendor"]),
    ("Ruby", ["Gemfile"], [], [], [".bundle", "vendor/bundle"]),
    ("iOS / Swift", ["Package.swift"], [".xcodeproj", ".xcworkspace"], [], [".build", "DerivedData"]),
    ("Android", ["AndroidManifest.xml"], [], [], ["build", ".gradle", ".idea"]),
    ("Linux kernel", ["Kbuild", "MAINTAINERS"], [], ["Kconfig"], [".tmp_versions", "include/generated", "include/config", "arch/x86/include/generated", "arch/arm/include/generated", "arch/arm64/include/generated", "tools/testing/selftests/output", "Documentation/output", "rust/target"]),
    ("C / CMake", ["CMakeLists.txt"], [], [], ["build", "cmake-build-debug", "cmake-build-release", "_build"]),
    ("C / Meson", ["meson.build"], [], [], ["builddir", "_build"]),
    ("C / Autotools", ["configure.ac", "configure.in", "Makefile.am"], [], [], ["autom4te.cache", ".deps", ".libs"]),
    ("C / Make", ["Makefile", "makefile", "GNUmakefile"], [], [], []),
]
# Package managers by a file at the root.
PACKAGE_MANAGERS = {
    "pnpm-lock.yaml": "pnpm", "package-lock.json": "npm", "yarn.lock": "Yarn", "bun.lockb": "Bun", "bun.lock": "Bun", "poetry.lock": "Poetry", "Pipfile": "Pipenv", "requirements.txt": "pip/requirements.txt", "go.mod": "Go modules", "Cargo.toml": "Cargo",
}
# What a dependency's name tells, and of which part of a stack.
DEPENDENCY_STACK = {
    "react": ("React", "frontend"), "@vitejs/plugin-react": ("Vite React plugin", "frontend"), "vite": ("Vite", "tools"), "next": ("Next.js", "frontend"), "vue": ("Vue", "frontend"), "nuxt": ("Nuxt", "frontend"), "svelte": ("Svelte", "frontend"),
    "@sveltejs/kit": ("SvelteKit", "frontend"), "astro": ("Astro", "frontend"), "typescript": ("TypeScript", "tools"), "tailwindcss": ("Tailwind CSS", "styling"), "@tailwindcss/vite": ("Tailwind CSS Vite plugin", "styling"), "sass": ("Sass", "styling"), "less": ("Less", "styling"),
    "zustand": ("Zustand", "frontend"), "zod": ("Zod", "frontend"), "@tanstack/react-query": ("TanStack Query", "frontend"), "@tanstack/react-router": ("TanStack Router", "frontend"), "react-router": ("React Router", "frontend"), "react-hook-form": ("React Hook Form", "frontend"),
    "framer-motion": ("Framer Motion", "frontend"), "lucide-react": ("Lucide React", "frontend"), "recharts": ("Recharts", "frontend"), "echarts": ("ECharts", "frontend"), "vitest": ("Vitest", "testing"), "jest": ("Jest", "testing"), "@playwright/test": ("Playwright", "testing"),
    "cypress": ("Cypress", "testing"), "storybook": ("Storybook", "testing"), "@storybook/react": ("Storybook React", "testing"), "eslint": ("ESLint", "tools"), "prettier": ("Prettier", "tools"), "express": ("Express", "backend"), "fastify": ("Fastify", "backend"), "nestjs": ("NestJS", "backend"),
}
# Names of configuration files.
CONFIG_FILES = [
    "package.json", "pnpm-lock.yaml", "package-lock.json", "yarn.lock", "bun.lockb", "tsconfig.json", "jsconfig.json", "vite.config.ts", "vite.config.js", "next.config.js", "next.config.mjs", "next.config.ts", "eslint.config.js", "eslint.config.mjs", ".eslintrc", ".eslintrc.js", ".eslintrc.json",
    ".prettierrc", ".prettierrc.json", "prettier.config.js", "tailwind.config.js", "tailwind.config.ts", "postcss.config.js", "components.json", "pyproject.toml", "requirements.txt", "requirements-dev.txt", "poetry.lock", "Pipfile", "Pipfile.lock", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock",
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".env.example", ".gitignore", "README.md", "LICENSE",
]
WORKFLOWS = ".github/workflows/"
# What configuration shows to be in use: a pattern over the lower-case name (or path, where it has `/`).
CHECKLIST = {
    "TypeScript": r"^tsconfig\.json$", "Vite": r"^vite\.config", "ESLint": r"eslint", "Prettier": r"prettier", "Tailwind CSS": r"^tailwind\.config", "PostCSS": r"^postcss\.config", "Docker": r"^dockerfile", "Docker Compose": r"^(docker-)?compose\.ya?ml$", "GitHub Actions": r"^\.github/workflows/",
    "Python pyproject": r"^pyproject\.toml$", "Go modules": r"^go\.mod$", "Rust Cargo": r"^cargo\.toml$", "Environment examples": r"^\.env",
}
# Languages whose comments can be taken out, by extension; makefiles by name as well.
STRIPPED_LANGUAGES = {
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "TSX", "py": "Python", "pyw": "Python", "pyi": "Python", "go": "Go", "rs": "Rust", "java": "Java", "cs": "C#", "php": "PHP", "phtml": "PHP",
    "rb": "Ruby", "rake": "Ruby", "gemspec": "Ruby", "c": "C", "h": "C", "cpp": "C++", "cxx": "C++", "cc": "C++", "hpp": "C++", "hh": "C++", "hxx": "C++", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "mk": "Makefile", "mak": "Makefile", "kt": "Kotlin", "kts": "Kotlin",
}
MAKEFILES = ["makefile", "gnumakefile"]
