"""Settings: a TOML file under environment variables over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace

from weftwork.vocab import Vocabulary

ENV = "WEFTWORK_"


@dataclass(frozen=True)
class Corpus:
    path: str = "corpus"
    lang: str = "en"


@dataclass(frozen=True)
class Artifacts:
    """Where tables go, and where they are read from if that is another place."""

    path: str = "artifacts"
    source_path: str = ""

    def reads(self, name: str) -> str:
        return f"{(self.source_path or self.path).rstrip('/')}/{name}"

    def writes(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"


@dataclass(frozen=True)
class Embedding:
    model: str = "hashing"
    dimensions: int = 384
    batch_size: int = 64


@dataclass(frozen=True)
class Retrieval:
    dense_top_k: int = 24
    #: Share of the dense results that the index may miss, as expected; 0 looks into all of it.
    dense_missed: float = 0.0
    final_top_k: int = 6


@dataclass(frozen=True)
class Generation:
    url: str = ""
    model: str = ""
    timeout_seconds: int = 120
    temperature: float = 0.1


@dataclass(frozen=True)
class Config:
    corpus: Corpus = field(default_factory=Corpus)
    artifacts: Artifacts = field(default_factory=Artifacts)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)


def load_config(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """``WEFTWORK_<SECTION>_<NAME>`` wins over the file, the file over the default; unknown names are an error."""
    given = {}
    if path:
        with open(path, "rb") as f:
            given = tomllib.load(f)
    env = os.environ if env is None else env
    known = {*(f.name for f in fields(Config)), "vocabulary"}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    config = Config()
    for section in fields(Config):
        own = getattr(config, section.name)
        values = dict(given.get(section.name, {}))
        if unknown := sorted(set(values) - {f.name for f in fields(own)}):
            raise ValueError(f"unknown settings in {path}, {section.name}: {', '.join(unknown)}")
        for f in fields(own):
            if (value := env.get(f"{ENV}{section.name}_{f.name}".upper())) is not None:
                values[f.name] = value
        typed = {name: type(getattr(own, name))(value) for name, value in values.items()}
        config = replace(config, **{section.name: replace(own, **typed)})
    return replace(config, generation=replace(config.generation, url=config.generation.url.rstrip("/")))


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The words of a site, from the section ``vocabulary`` of the settings; what it does not name is as by default.

    Lists are tuples here; ``label_rules`` is a list of pairs: patterns and their label.
    """
    if not path:
        return Vocabulary()
    with open(path, "rb") as f:
        given = tomllib.load(f).get("vocabulary", {})
    if unknown := sorted(set(given) - {f.name for f in fields(Vocabulary)}):
        raise ValueError(f"unknown settings in {path}, vocabulary: {', '.join(unknown)}")

    def fixed(value):
        if isinstance(value, dict):
            return {k: fixed(v) for k, v in value.items()}
        return tuple(map(fixed, value)) if isinstance(value, list) else value

    return Vocabulary(**{name: fixed(value) for name, value in given.items()})
