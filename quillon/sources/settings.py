"""Settings from a TOML file, overridden by the environment; keys stay in the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields
from urllib.parse import urlparse


@dataclass(frozen=True)
class Settings:
    url: str = ""
    model: str = ""
    key_variable: str = ""
    embedding_path: str = ""
    max_tokens: int = 1024
    timeout: int = 60
    evidence_chars: int = 16_000
    thinking: bool = False
    key: str = ""


def load_settings(path: str | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """QUILLON_URL, QUILLON_MODEL and QUILLON_EMBEDDING_PATH override the file; key_variable names the
    variable that holds the key. Unknown entries, wrong types and values out of bounds are errors."""
    environ = os.environ if environ is None else environ
    values = tomllib.loads(open(path, encoding="utf-8").read()) if path else {}
    known = {f.name: type(f.default) for f in fields(Settings) if f.name != "key"}
    for name, value in values.items():
        if name not in known or type(value) is not known[name]:
            raise ValueError(f"bad setting {name}")
    values |= {n: environ[v] for n in ("url", "model", "embedding_path") if (v := f"QUILLON_{n.upper()}") in environ}
    out = Settings(**values, key=environ.get(values.get("key_variable", ""), ""))
    if not (1 <= out.max_tokens <= 4096 and 1 <= out.timeout <= 120 and 100 <= out.evidence_chars <= 64_000):
        raise ValueError("a setting is out of bounds")
    return out


def check_local(url: str, model: str) -> str:
    """The address of a generator on this machine, without a slash at its end; anything else is an error."""
    u = urlparse(url)
    if u.scheme != "http" or u.hostname not in {"127.0.0.1", "localhost", "::1"}:
        raise ValueError("a local generator has an http address on this machine")
    if u.username or u.password or u.query or u.fragment or u.path not in {"", "/"}:
        raise ValueError("a local address has a host and a port only")
    if not model.strip() or model.lower().endswith("cloud"):
        raise ValueError("a local generator needs the name of a local model")
    return url.rstrip("/")


def check_remote(s: Settings) -> str:
    """The address of a remote generator's chat completions; needs https, a model and a key, no credentials."""
    u = urlparse(s.url)
    if u.scheme != "https" or not u.hostname or u.username or u.password or u.query or u.fragment:
        raise ValueError("a remote generator has a plain https address")
    if not s.model.strip() or not s.key.strip() or "\n" in s.key or "\r" in s.key:
        raise ValueError("a remote generator needs a model and a key on one line")
    return s.url.rstrip("/") + "/chat/completions"
