"""Conversion options (O1 to O3)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .functions.text import norm_key
from .functions.vocab import DROP_SECTIONS, LABEL_HEADINGS


@dataclass(frozen=True)
class Options:
    category: str = ""
    split: int = 0
    title: str = ""
    top_level: int = 2
    max_level: int = 3
    image_dir: str = "images"
    keep_cover: bool = False
    drop_sections: tuple[str, ...] = DROP_SECTIONS
    labels: tuple[str, ...] = LABEL_HEADINGS
    label_style: str = "bold"
    no_callouts: bool = False
    no_frontmatter: bool = False
    hidden: bool = True
    callout_style: str = "component"
    force_markdown: bool = False

    def __post_init__(self):
        domains = {"split": (0, 1, 2), "top_level": (1, 2, 3, 4, 5, 6), "max_level": (3, 4, 6), "label_style": ("bold", "plain"), "callout_style": ("component", "blockquote", "plain")}
        for name, allowed in domains.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}")


def from_choices(label_style: str = "bold", keep_cover: bool = False, extra_labels: tuple[str, ...] = (), **more) -> Options:
    """O2: as a form gives them. Keeping labels empties their list, keeping the cover keeps sections too."""
    out = Options(keep_cover=keep_cover, label_style="bold" if label_style == "keep" else label_style, **more)
    if label_style == "keep":
        out = replace(out, labels=())
    else:
        out = replace(out, labels=out.labels + tuple(k for k in map(norm_key, extra_labels) if k))
    return replace(out, drop_sections=()) if keep_cover else out
