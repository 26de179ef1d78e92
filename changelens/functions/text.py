"""Scalar column functions: paths, lines, languages, file classes, URLs, declarations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on, as sets of names.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "go": "go", "rs": "rust",
}
SKIPPED_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".gradle", ".idea", "target",
    ".mypy_cache", "coverage", ".expo", "Pods", "DerivedData", ".ruff_cache", "coding_agent.egg-info", ".pytest_cache",
)
LOCKFILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "composer.lock", "gemfile.lock",
    "poetry.lock", "pdm.lock", "cargo.lock", "go.sum", "packages.lock.json", "podfile.lock", "flake.lock", "uv.lock",
)
GENERATED = (
    ".min.js", ".min.css", ".map", ".pb.go", "_pb2.py", "_pb2_grpc.py", ".pb.cc", ".pb.h", ".g.dart",
    ".freezed.dart", ".g.kt", ".generated.ts", ".generated.js",
)
VENDORED = (
    "/node_modules/", "/vendor/", "/dist/", "/build/", "/.next/", "/out/", "/target/", "/__generated__/",
    "/generated/", "/third_party/", "/.gradle/",
)
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".pdf", ".woff", ".woff2", ".ttf", ".eot", ".mp4",
    ".mov", ".zip", ".gz", ".tar", ".jar", ".class", ".so", ".dll", ".dylib", ".bin", ".snap",
)
HUGE_CHANGE = 2000
#: What starts a declaration in each language; the first group that matched is the name.
DECLARATIONS = {
    "kotlin": (
        r"^\s*(?:(?:override|private|internal|public|protected|suspend|inline|abstract|open|sealed|data|fun)\s+)*fun\s+(\w+)",
        r"^\s*(?:(?:abstract|open|sealed|data|inner|private|internal|public|enum)\s+)*class\s+(\w+)",
        r"^\s*(?:private\s+)?object\s+(\w+)",
        r"^\s*interface\s+(\w+)",
    ),
    "java": (
        r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|strictfp)\s+)*"
        r"(?:void|boolean|int|long|double|float|String|[A-Z]\w*)(?:<[^>]+>)?\s+(\w+)\s*\(",
        r"^\s*(?:(?:public|private|protected|abstract|final)\s+)*class\s+(\w+)",
        r"^\s*interface\s+(\w+)",
    ),
    "python": (r"^\s*(?:async\s+)?def\s+(\w+)", r"^\s*class\s+(\w+)"),
    "javascript": (r"^\s*(?:async\s+)?function\s+(\w+)", r"^\s*class\s+(\w+)", r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\("),
    "typescript": (
        r"^\s*(?:async\s+)?function\s+(\w+)",
        r"^\s*(?:export\s+)?class\s+(\w+)",
        r"^\s*interface\s+(\w+)",
        r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?\(",
    ),
    "go": (r"^\s*func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(",),
    "rust": (
        r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",
        r"^\s*(?:pub\s+)?impl(?:\s+\w+)?\s+(?:for\s+)?(\w+)",
        r"^\s*(?:pub\s+)?struct\s+(\w+)",
        r"^\s*(?:pub\s+)?enum\s+(\w+)",
        r"^\s*(?:pub\s+)?trait\s+(\w+)",
    ),
}
#: Fixed value: the keywords before a name in a hunk header's hint.
HINT_NAME = r"(?U)\b(?:fun|def|func|function|class|interface|object|struct|impl|trait|enum)\s+(\w+)"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def any_suffix(column: Column, suffixes) -> Column:
    return column.rlike("(" + "|".join(map(quoted, suffixes)) + ")$")


def split_lines(text: Column) -> Column:
    """The lines of a text at every line end Unicode knows, without an empty last one."""
    bare = F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", "")  # so that one split suffices
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(bare, LINE_ENDS, -1))


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """The language of a path's extension, or null."""
    ext = F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_DIRS)))


def skip_reason(path: Column, changed: Column) -> Column:
    """Why a file is noise to a reviewer, or null when it is reviewable."""
    p = F.lower(path)
    marked = F.concat(F.lit("/"), p).rlike("(" + "|".join(map(quoted, VENDORED)) + ")")
    return (
        F.when(basename(p).isin(*LOCKFILES), F.lit("lockfile"))
        .when(any_suffix(p, GENERATED), F.lit("generated"))
        .when(marked, F.lit("vendored/build artifact"))
        .when(any_suffix(p, BINARY), F.lit("binary/asset"))
        .when(changed > HUGE_CHANGE, F.concat(F.lit("very large change ("), changed.cast("string"), F.lit(" lines, likely generated)")))
    )


def count_lines(lines: Column, sign: str) -> Column:
    """Lines that start with a sign, but not with three of it."""
    return F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))


def declared_name(text: Column, lang: Column) -> Column:
    """The name a line declares in its language, or null."""
    out = F.lit(None).cast("string")
    for name, patterns in DECLARATIONS.items():
        found = F.coalesce(*[F.nullif(F.regexp_extract(text, "(?U)" + p, 1), F.lit("")) for p in patterns])
        out = F.when(lang == name, found).otherwise(out)
    return out


def hint_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, HINT_NAME, 1), F.lit(""))


def symbol_type(text: Column) -> Column:
    """The kind of a declaration, by the words its text contains."""
    t = F.lower(text)
    has = lambda *words: F.greatest(*[t.contains(w) for w in words], F.lit(False))
    return (
        F.when(has("class", "object", "struct", "impl"), F.lit("class"))
        .when(has("interface", "trait"), F.lit("interface"))
        .when(has("enum"), F.lit("enum"))
        .when(has("fun ", "def ", "func ", "function "), F.lit("function"))
        .otherwise(F.lit("other"))
    )


def usage_type(line: Column, symbol: Column) -> Column:
    """How a line uses a symbol, by patterns; rules in order of precedence."""
    name = F.concat(F.lit(r"\Q"), symbol, F.lit(r"\E"))
    word = F.concat(F.lit(r"(?<![A-Za-z0-9_])"), name, F.lit(r"(?![A-Za-z0-9_])"))
    define = F.concat(F.lit(r"(?:def|class|fun|func|function|fn|interface|struct|trait|enum|object)\s+"), name, F.lit(r"(?![A-Za-z0-9_])"))
    return (
        F.when(line.rlike(r"^\s*(?:import|from|use|require|include)\b"), F.lit("import"))
        .when(F.regexp(line, define), F.lit("definition"))
        .when(line.rlike(r"^\s*(?:(?:const|let|var|val|final)\s+)?[A-Za-z_][A-Za-z0-9_.]*\s*=[^=]"), F.lit("assignment"))
        .when(F.regexp(line, F.concat(word, F.lit(r"\s*\("))), F.lit("call"))
        .when(F.regexp(line, F.concat(F.lit(r"[:<]\s*"), name, F.lit(r"(?![A-Za-z0-9_])"))), F.lit("type_reference"))
        .otherwise(F.lit("reference"))
    )


def normal_remote(url: Column) -> Column:
    """A remote URL such that equivalent ones compare equal: host/path in lower case."""
    u = F.lower(F.trim(url))
    scp = u.startswith("git@") & u.contains(":")
    u = F.when(scp, F.regexp_replace(F.regexp_replace(u, "^git@", ""), "^([^:]*):", "$1/")).otherwise(u)
    for scheme in ("https://", "http://", "ssh://", "git://"):
        u = F.regexp_replace(u, "^" + scheme, "")
    u = F.regexp_replace(u, "^[^/@]*@", "")
    return F.when(u.endswith(".git"), F.regexp_replace(u, r"\.git$", "")).otherwise(F.regexp_replace(u, "/+$", ""))


def platform(url: Column) -> Column:
    return F.when(url.contains("merge_requests/"), F.lit("gitlab")).when(url.contains("/pull/"), F.lit("github"))


def review_number(url: Column) -> Column:
    parts = F.split(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$|^/+|/+$", ""), "/")
    pull = F.when(F.try_element_at(parts, F.lit(3)) == "pull", F.try_element_at(parts, F.lit(4)).try_cast("int"))
    return F.when(platform(url) == "gitlab", F.regexp_extract(url, r"merge_requests/(\d+)", 1).try_cast("int")).when(platform(url) == "github", pull)


def repository(url: Column, base: str = "") -> Column:
    """The project path of a review URL; ``base`` is the GitLab host that is cut off."""
    lab = F.replace(url, F.lit(base), F.lit("")) if base else url
    lab = F.element_at(F.split(F.regexp_replace(lab, r"^/+|/+$", ""), "/-/"), 1)
    parts = F.split(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"^/+|/+$", ""), "/")
    hub = F.concat_ws("/", F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)))
    return F.when(platform(url) == "gitlab", lab).when(platform(url) == "github", hub)


def index_key(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def glob_pattern(glob: str) -> str:
    """The pattern of paths that a file glob selects: without a slash at any depth, else from the root."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        close = glob.find("]", i + 2) if c == "[" else -1
        if close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", close + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if "{" in glob[:i] and "}" in glob[i:] else ","}.get(c) or re.escape(c)
        i += 1
    return ("^" if "/" in glob else "^(?:.*/)?") + out.lstrip("/") + "$"
