"""Configuration in TOML, and its check."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

SECRETS = ("tmdb_token", "tmdb_api_key", "tvdb_api_key", "opensubtitles_api_key", "opensubtitles_password")


@dataclass
class Destination:
    name: str
    root: str
    media: list[str] = field(default_factory=list)
    network: bool = False

    def accepts(self, category: str) -> bool:
        return not self.media or category in self.media


@dataclass
class Config:
    staging_root: str | None = None
    headroom_gb: float = 0.0
    reclaim: bool = False
    destinations: list[Destination] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    keep_languages: dict[str, list[str]] = field(default_factory=dict)
    api: dict[str, str] = field(default_factory=dict)

    def redacted(self) -> Config:
        """A copy to show: no secret in it."""
        return Config(**{**self.__dict__, "api": {k: "(set)" if k in SECRETS and v else v for k, v in self.api.items()}})

    def languages_for(self, title: str) -> list[str] | None:
        """Languages to keep for a title, its own list added to the common one; None keeps all."""
        import re

        plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
        names = {plain(title), plain(re.sub(r" \([0-9]*\)\s*$", "", title))}
        own = next((v for k, v in self.keep_languages.items() if plain(k) in names), None)
        return None if not self.languages and own is None else list(dict.fromkeys([*self.languages, *(own or [])]))


def load(text: str, environ: dict[str, str] | None = None) -> Config:
    """A Config from TOML; REELSLEUTH_<KEY> in the environment wins over a key of [api]."""
    raw = tomllib.loads(text)
    staging, video = raw.get("staging", {}), raw.get("video", {})
    api = {k: str(v) for k, v in raw.get("api", {}).items()}
    for k in SECRETS:
        if found := (os.environ if environ is None else environ).get(f"REELSLEUTH_{k.upper()}"):
            api[k] = found
    places = [Destination(d["name"], d["root"], d.get("media", []), d.get("network", False)) for d in raw.get("destination", [])]
    return Config(staging.get("root"), staging.get("min_free_headroom_gb", 0), staging.get("reclaim_after_migrate", False), places, video.get("languages", []), video.get("keep_languages", {}), api)


def check(config: Config) -> list[tuple[str, str, str]]:
    """(subject, level, detail) rules at ok, warning or error."""
    rows = [("staging", "error", "no root") if not config.staging_root else ("staging", "ok", config.staging_root)]
    if not config.destinations:
        rows.append(("destination", "warning", "none is configured"))
    names = [d.name for d in config.destinations]
    rows += [("destination", "error", f"{n} is named twice") for n in sorted({n for n in names if names.count(n) > 1})]
    rows += [("destination", "error", f"{d.name}: {d.root} is a URL, not a mount point") if "://" in d.root else ("destination", "ok", d.name) for d in config.destinations]
    return rows
