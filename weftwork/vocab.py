"""Words that the engine looks up. Site words (hosts, seed terms, hints) are a parameter: see ``Vocabulary``."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words without meaning for retrieval and for terms.
STOPWORDS = tuple(
    "a an and are as at be by do does for from how i in is it my of on or the to what when where which who why with "
    "was were will would can could should has have had not game games".split()
)
#: The validator's list lacks these four.
VALIDATOR_STOPWORDS = tuple(w for w in STOPWORDS if w not in ("i", "my", "game", "games"))

# Trigger words of query intents, and what they add to a query.
TROUBLESHOOTING = tuple(
    "bug broken cant can't crash error fix freeze glitch help issue issues lag lagging problem problems slow stutter "
    "stuttering trouble troubleshoot troubleshooting wont won't".split()
)
PERFORMANCE = tuple("fps frame frames framerate lag lagging latency performance slow stutter stuttering".split())
ACCESS = tuple("access download get install open use using".split())
DEFINITION = r"(?i)\bwhat\s+(?:is|are)\b|\bdefine\b|\bmeaning\s+of\b"
EXPANSIONS = {
    "troubleshooting": ("help", "issue", "problem", "troubleshooting"),
    "performance": ("lag", "performance", "frame", "fps", "latency", "stutter", "troubleshooting"),
    "access": ("access", "open", "use", "download"),
}
PROCEDURAL = r"(?m)(?:^\s*\d+\.|\b(?:open|click|download|install|use)\b)"

# Link texts that name nothing.
GENERIC_ANCHORS = (
    "", "a", "an", "and", "article", "click here", "details", "here", "link", "main article", "more", "page", "read more",
    "see", "source", "the", "this", "this article", "this page", "website", "wiki page",
)
NOISE_TERMS = ("img", "image", "main article", "click here", "game", "games")

# Order of chunk types and of decisions.
CHUNK_TYPES = ("article", "section", "table", "formula", "citation")
DECISIONS = ("accept", "review", "reject")
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp")
LINK_TYPES = ("wiki_article", "wiki_section", "wiki_asset", "site_internal", "external", "mailto", "other")

# Topics of each area, and path parts that decide before the topic does.
AREAS_BY_TOPIC = {
    "dev": ("development",),
    "tournaments": ("tournaments",),
    "mapping": ("beatmap", "beatmap_information", "beatmapping", "modding"),
    "help": ("help_centre", "performance_troubleshooting"),
    "gameplay": ("gameplay", "game_mode", "performance_points", "ranking"),
    "community": ("community", "people", "contests"),
    "client": ("client",),
    "moderation": ("rules", "legal"),
}
AREAS_BY_PATH = (
    ("tournaments", "tournaments"), ("beatmapping", "mapping"), ("modding", "mapping"), ("client", "client"), ("rules", "moderation"),
    ("legal", "moderation"), ("help_centre", "help"), ("performance_troubleshooting", "help"),
)

# Mentions that are no entities.
GENERIC_SUFFIXES = ("page", "pages", "section", "sections", "article", "articles")


@dataclass(frozen=True)
class Vocabulary:
    """Words of one site."""

    #: First-party hosts and the base of canonical addresses.
    hosts: tuple[str, ...] = ()
    base_url: str = ""
    #: Terms that are known beforehand, and a name whose spellings vary (``name!x``, ``name x``).
    seed_terms: tuple[str, ...] = ()
    brand: str = ""
    #: Aliases that always mean one page, and normalised terms that name nothing.
    manual_targets: dict[str, str] = field(default_factory=dict)
    generic_terms: tuple[str, ...] = ()
    #: Points that an intent gives to documents.
    document_hints: dict[str, dict[str, float]] = field(
        default_factory=lambda: {
            "troubleshooting": {"Help_centre": 4.0},
            "performance": {"Performance_troubleshooting": 14.0, "Help_centre/Client": 4.0},
        }
    )
    help_prefix: str = "Help_centre"
    performance_page: str = "Performance_troubleshooting"
    help_area: str = "help"
    #: Entity labels: profile -> labels; (substring of id and path -> label) in order; labels always asked for.
    label_profiles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"default": ("person", "event", "feature", "page")})
    label_rules: tuple[tuple[tuple[str, ...], str], ...] = ()
    always_labels: tuple[str, ...] = ()
