"""Settings: frozen dataclasses, merged and exchanged as JSON on the driver."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace
from typing import Any

#: Lines that are dropped wherever they stand alone.
BOILERPLATE = (
    r"^\d{1,4}$", r"^page\s+\d+\s+of\s+\d+$", r"^downloaded from .*", r"^doi\s*:?\s*\S*.*", r"^https?:\/\/\S+$", r"^issn\s*:?.*", r"^isbn\s*:?.*",
    r"^©.*", r"^copyright\b.*", r"^all rights reserved\.?$", r"^arxiv\s*:\s*\S+", r"^preprint\b.*", r"^this article is protected .*", r"^licen[cs]ed under .*",
)
#: Abbreviations and what is spoken for them, in the order in which they apply.
SUBSTITUTIONS = (
    ("e.g.", "for example"), ("i.e.", "that is"), ("et al.", "and colleagues"), ("etc.", "and so on"), ("cf.", "compare"), ("vs.", "versus"), ("approx.", "approximately"),
    ("fig.", "figure"), ("figs.", "figures"), ("eq.", "equation"), ("eqn.", "equation"), ("sec.", "section"), ("vol.", "volume"), ("ibid.", "in the same source"),
)


@dataclass(frozen=True)
class Boilerplate:
    enabled: bool = True
    patterns: tuple[str, ...] = BOILERPLATE


@dataclass(frozen=True)
class Repeated:
    enabled: bool = True
    minRepeatFraction: float | None = 0.1


@dataclass(frozen=True)
class Switch:
    enabled: bool = False


@dataclass(frozen=True)
class Bracket:
    enabled: bool = True
    minWords: int = 0
    alwaysStripCitations: bool = True
    replacement: str = ""


@dataclass(frozen=True)
class Brackets:
    parens: Bracket = Bracket(enabled=False, minWords=4)
    square: Bracket = Bracket()
    curly: Bracket = Bracket(alwaysStripCitations=False)


@dataclass(frozen=True)
class Captions:
    enabled: bool = True
    mode: str = "skip"
    keywords: tuple[str, ...] = ("figure", "fig", "table", "tbl")
    replacement: str = "figure omitted"


@dataclass(frozen=True)
class Tables:
    enabled: bool = True
    mode: str = "replace"
    replacement: str = "table omitted"


@dataclass(frozen=True)
class Headings:
    enabled: bool = True
    pauseAfterNumberMs: int = 120


@dataclass(frozen=True)
class StructuralPauses:
    enabled: bool = True
    betweenParagraphsMs: int = 100
    afterHeadingMs: int = 80
    beforeHeadingMs: int = 120
    beforeListMs: int = 25
    betweenListItemsMs: int = 20


@dataclass(frozen=True)
class PunctuationPauses:
    enabled: bool = True
    periodMs: int = 80
    questionMs: int = 110
    exclamationMs: int = 100
    commaMs: int = 5
    colonMs: int = 15
    semicolonMs: int = 20
    beforeParenMs: int = 5
    beforeSquareMs: int = 10
    beforeCurlyMs: int = 10


@dataclass(frozen=True)
class CutPauses:
    captionMs: int = 0
    bracketMs: int = 0
    tableMs: int = 0


@dataclass(frozen=True)
class Substitution:
    match: str
    replace: str = ""
    wholeWord: bool = True
    caseSensitive: bool = False


@dataclass(frozen=True)
class Config:
    removeBoilerplate: Boilerplate = Boilerplate()
    removeRepeatedHeadersFooters: Repeated = Repeated()
    stopAtReferences: Switch = Switch()
    brackets: Brackets = Brackets()
    figuresAndTables: Captions = Captions()
    tables: Tables = Tables()
    headings: Headings = Headings()
    structuralPauses: StructuralPauses = StructuralPauses()
    punctuationPauses: PunctuationPauses = PunctuationPauses()
    pauses: CutPauses = CutPauses()
    substitutions: tuple[Substitution, ...] = tuple(Substitution(m, r, wholeWord=False) for m, r in SUBSTITUTIONS)
    debugMode: bool = False

    def for_selection(self) -> Config:
        """Settings for a selected passage: no rule that needs a document around it."""
        return replace(
            self,
            removeBoilerplate=replace(self.removeBoilerplate, enabled=False),
            removeRepeatedHeadersFooters=replace(self.removeRepeatedHeadersFooters, enabled=False),
            tables=replace(self.tables, enabled=False),
            figuresAndTables=replace(self.figuresAndTables, enabled=False),
            structuralPauses=replace(self.structuralPauses, enabled=False),
        )


@dataclass(frozen=True)
class Settings:
    modelDir: str = ""
    engineOverride: str = ""
    numThreads: int = 2
    speed: float = 1.0
    rememberPosition: bool = True
    lastPositions: dict[str, int] = field(default_factory=dict)
    config: Config = Config()


def deep_merge(base: Any, override: Any) -> Any:
    """Override values, null too, under keys of `base`; lists are replaced whole, other keys of `override` are dropped."""
    if not isinstance(base, dict):
        return override
    if not isinstance(override, dict):
        return base
    return {k: deep_merge(v, override[k]) if k in override else v for k, v in base.items()}


def to_dict(config: Config) -> dict:
    return json.loads(json.dumps(asdict(config)))


def from_dict(raw: dict) -> Config:
    """A complete nested dictionary, as to_dict gives it."""
    kinds = {f: type(getattr(Config(), f)) for f in Config.__dataclass_fields__}
    made: dict[str, Any] = {}
    for name, kind in kinds.items():
        value = raw.get(name, to_dict(Config())[name])
        if name == "brackets":
            made[name] = Brackets(**{k: Bracket(**v) for k, v in value.items()})
        elif name == "substitutions":
            made[name] = tuple(Substitution(v["match"], v.get("replace") or "", v.get("wholeWord") is not False, bool(v.get("caseSensitive"))) for v in value)
        elif name == "debugMode":
            made[name] = bool(value)
        else:
            made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
    return Config(**made)


def load_settings(stored: dict | None) -> Settings:
    """Stored settings over the defaults. Saved positions are kept, though merging would drop keys that the defaults lack."""
    base = asdict(Settings())
    base["config"] = to_dict(Config())
    merged = deep_merge(base, stored or {})
    merged["lastPositions"] = dict((stored or {}).get("lastPositions") or {})
    merged["config"] = from_dict(merged["config"])
    return Settings(**merged)


def export_json(settings: Settings) -> str:
    return json.dumps({
        "config": to_dict(settings.config),
        "model": {"modelDir": settings.modelDir, "engineOverride": settings.engineOverride, "numThreads": settings.numThreads, "speed": settings.speed},
    }, indent=2)


def import_json(settings: Settings, text: str) -> Settings:
    """Replace the configuration wholesale; a file without one is an error, a bad number of threads is ignored."""
    raw = json.loads(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("config"), dict):
        raise ValueError("the file has no config object")
    model = raw.get("model") if isinstance(raw.get("model"), dict) else {}
    threads = model.get("numThreads")
    good = isinstance(threads, (int, float)) and not isinstance(threads, bool) and math.isfinite(threads) and threads > 0
    known = {k: model[k] for k in ("modelDir", "engineOverride", "speed") if k in model}
    return replace(settings, config=from_dict(raw["config"]), **known, **({"numThreads": int(threads)} if good else {}))


def comma_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def line_list(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n") if x.strip()]
