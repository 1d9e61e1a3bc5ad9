"""Small projects as literal rows, for operators of which the tables hold no case: build files, imports, risky code, roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.runtime import ship

PACKAGE = '{"name": "shop", "dependencies": {"react": "^18", "zod": "3", "left-pad": "1"}, "devDependencies": {"vite": "5", "eslint": "9"}, "scripts": {"build": "vite build"}}'
COMPOSE = "services:\n  web:\n    image: nginx\n    ports:\n      - 80:80\n  db:\n    image: postgres\n    environment:\n      POSTGRES_DB: shop\n"

#: project_id, doc_id, rel_path, text.
FILES = [
    (1, 1, "requirements.txt", "flask==3.0\nrequests>=2  # http\n# none\n-r dev.txt\n"),
    (1, 2, "pyproject.toml", "[project]\nname = 'shop'\n"),
    (1, 3, "app\\__init__.py", "import os\n"),
    (1, 4, "app\\main.py", "import os, app.store as s\nfrom . import util\nfrom .store import rows\nfrom app import util\nfrom ..app.deep.leaf import x\n\n\ndef main():\n    value = eval(input())\n    exec(value)\n    return rows\n"),
    (1, 5, "app\\util.py", "import pickle\nimport yaml\n\nclass Loader:\n    def load(self, f):\n        return pickle.load(f)\n\n    def conf(self, f):\n        return yaml.load(f)\n\ndef run(cmd):\n    subprocess.run(cmd, shell=True)\n"),
    (1, 6, "app\\store.py", "from app.util import Loader; import app.deep.leaf\nfrom flask import Flask\n@app.get('/rows')\ndef rows():\n    pass\n\n@bp.route('/old')\ndef old():\n    pass\n"),
    (1, 7, "app\\deep\\leaf.py", "# import app.main\nfrom ..main import main\nfrom ... import nothing\n"),
    (1, 8, "Makefile", "build: dep\n\tgo build\ntest:\n\tpytest\n.PHONY: build\nX := 1\n"),
    (1, 9, "docs\\requirements.txt", "sphinx\n"),
    (1, 10, ".env", "A=1\n"),
    (1, 11, "keys\\server.pem", "x\n"),
    (2, 21, "package.json", PACKAGE),
    (2, 22, "pnpm-lock.yaml", "lockfileVersion: 9\n"),
    (2, 23, "tsconfig.json", "{}\n"),
    (2, 24, "src\\index.ts", "import { App } from './app';\nimport x from \"../lib/x.js\";\nconst y = require('./deep');\nimport('react');\nexport function useCart() { return fetch('/api/cart'); }\n"),
    (2, 25, "src\\app.tsx", "import { useCart } from './index';\nexport default function App() { return null }\nconst Card = (props) => null;\ndocument.write(x);\nel.innerHTML = x;\nif (el.innerHTML == x) {}\nlocalStorage.setItem('token', t);\n"),
    (2, 26, "src\\deep\\index.js", "router.post('/cart', save);\naxios.get(`${base}/api/cart`);\nfetch('local.json');\n"),
    (2, 27, "lib\\x.js", "export default 1;\n"),
    (2, 28, "docker-compose.yml", COMPOSE),
    (2, 29, ".github\\workflows\\ci.yml", "on: push\n"),
    (3, 31, "go.mod", "module example.test/shop // ours\n\ngo 1.22\n\nrequire (\n\tgithub.com/x/y v1.2.3\n)\nrequire example.test/z v0.1.0\n"),
    (3, 32, "cmd\\main.go", 'package main\n\nimport (\n\t"fmt"\n\tst "example.test/shop/store"\n\t"example.test/shop"\n)\n\nfunc main() { http.HandleFunc("/go", h) }\n'),
    (3, 33, "store\\b.go", "package store\n"),
    (3, 34, "store\\a.go", 'package store\n\nimport "example.test/shop/none"\n'),
    (3, 35, "root.go", "package shop\n"),
    (4, 41, "Kconfig", "config X\n"),
    (4, 42, "Kbuild", "obj-y\n"),
    (4, 43, "Makefile", "all:\n\tmake\n"),
    (4, 44, "vendor.sln", "x\n"),
    (5, 51, "Kconfig", "config X\n"),
    (5, 52, "id_rsa", "x\n"),
    (5, 53, "credentials.json", "{}\n"),
    (5, 54, "config\\.env.sample", "A=\n"),
]


def files(spark: SparkSession) -> DataFrame:
    ship(spark)
    rows = spark.createDataFrame(FILES, "project_id long, doc_id long, rel_path string, text string")
    return rows.withColumn("size", F.octet_length("text").cast("long"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: The same rows as the SQL table documents.
SQL = "WITH documents AS (SELECT project_id, doc_id, rel_path, text, '' AS source, '' AS lang FROM (VALUES " + ", ".join(f"(CAST({p} AS BIGINT), CAST({d} AS BIGINT), {_text(r)}, {_text(t)})" for p, d, r, t in FILES) + ") AS v(project_id, doc_id, rel_path, text))"


def over(sql: str) -> str:
    """SQL over the corpus as SQL over these rows."""
    body = sql.strip()
    return SQL + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)


#: project_id, oid, author, at.
COMMITS = [(1, "a1", "Ada", 10), (1, "a2", "Ben", 20), (1, "a3", "Ada", 30), (1, "a4", "Ada", 30), (1, "a4", "Ada", 30), (2, "b1", "Cy", 5)]
#: project_id, oid, path, inserted, deleted.
CHANGES = [(1, "a1", "x", 9, 9), (1, "a2", "x", 3, 1), (1, "a3", "x", 1, 0), (1, "a3", "y", 5, 5), (1, "a4", "y", 2, 2), (2, "b1", "x", 7, 0), (2, "none", "x", 1, 1)]
#: project_id, path, oid of two trees.
BEFORE = [(1, "a", "o1"), (1, "b", "o2"), (1, "c", "o3"), (1, "d", "o3"), (1, "same", "o9"), (2, "a", "o1")]
AFTER = [(1, "a", "o1x"), (1, "e", "o3"), (1, "f", "o3"), (1, "g", "o3"), (1, "new", "o5"), (1, "same", "o9"), (2, "moved", "o1")]


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def values_sql(name: str, values: list[tuple], columns: str) -> str:
    """name(columns) AS a common table expression over the values; whole numbers are BIGINT."""
    cells = ["(" + ", ".join(f"CAST({x} AS BIGINT)" if isinstance(x, int) else _text(x) for x in v) + ")" for v in values]
    return f"{name}({columns}) AS (VALUES {', '.join(cells)})"
