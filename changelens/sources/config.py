"""Connection settings of platforms: a TOML file, then Spark's configuration, then environment variables."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULT_URL = {"gitlab": "https://gitlab.com", "github": ""}
OFF = ("0", "false", "no", "off")


@dataclass(frozen=True)
class Platform:
    name: str
    url: str
    token: str = field(repr=False)  # never printed


def expand(value: str, env: Mapping[str, str]) -> str:
    """``${NAME}`` replaced by the variable of that name, or by nothing."""
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m.group(1), ""), value)


def load(name: str, path: str | None = None, spark: SparkSession | None = None, env: Mapping[str, str] | None = None) -> Platform:
    """The settings of a platform; a file's section wins over ``changelens.<name>.*`` of Spark, that over NAME_URL and NAME_TOKEN."""
    env = os.environ if env is None else env
    section: dict = {}
    if path and Path(path).is_file():
        section = tomllib.loads(Path(path).read_text(encoding="utf-8")).get(name, {})

    def find(key: str) -> str:
        if section.get(key):
            return expand(str(section[key]), env)
        if spark is not None and (v := spark.conf.get(f"changelens.{name}.{key}", None)):
            return v
        return env.get(f"{name.upper()}_{key.upper()}", "")

    token = find("token")
    if not token:
        raise ValueError(f"no token for {name}: set it in the file, in Spark's configuration or in {name.upper()}_TOKEN")
    return Platform(name, (find("url") or DEFAULT_URL.get(name, "")).rstrip("/"), token)


def api_base(platform: Platform) -> str:
    """Where a platform's API is; a GitHub Enterprise host needs a suffix."""
    if platform.name == "github" and platform.url and not platform.url.endswith("/api/v3"):
        return platform.url + "/api/v3"
    return platform.url


def scrub(message: str, platform: Platform) -> str:
    return message.replace(platform.token, "***") if platform.token else message


def auto_index(env: Mapping[str, str] | None = None) -> bool:
    """Indexes are built on first use unless CHANGELENS_AUTO_INDEX says no."""
    return (os.environ if env is None else env).get("CHANGELENS_AUTO_INDEX", "1").strip().lower() not in OFF
