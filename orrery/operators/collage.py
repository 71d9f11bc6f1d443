"""Which slides of a post become collages, of which items, in which template."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orrery.operators.pack import LARGEST_COST, TEMPLATES

# Cost of each place down a chapter's list of templates, of each use of a template before, and what an item
# of another kind than a template prefers loses in score.
PLACE_COST, REPEAT_COST, OTHER_KIND = 0.08, 0.04, 0.15
# Least score and differing bits of companions, their greatest cosine, their distance in time from the lead.
LEAST_SCORE, LEAST_BITS, MOST_LIKE, NEAR_US = 0.5, 12, 0.85, 45 * 60_000_000
WIDE = 1.2
# Fixed value: cost of a template that isn't in a chapter's list.
OUTSIDE = 0.30
#: Templates of wide cells only, which upright companions don't fit.
STACKED = {"halves", "stack"}


@dataclass
class Rules:
    """Collages of upright leads a chapter may have, templates it may use in order of preference (`grid` if not given),
    uses of a template in a post, kinds that a template prefers, and whether the first slide may be a collage."""

    quota: dict[str, int] = field(default_factory=dict)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    most: dict[str, int] = field(default_factory=dict)
    preferred: dict[str, set[str]] = field(default_factory=dict)
    first: bool = True


def order_cells(aspects: list[float], hero: int, template: str) -> tuple[float, tuple[int, ...]]:
    """Least mean of abs(log(aspect / cell aspect)), more where the hero isn't in the largest cell, and the order of the
    items over the cells that has it; the first best wins. A template has few cells, so all orders are tried."""
    cells = TEMPLATES[template]
    largest = max(range(len(cells)), key=lambda i: (cells[i][2] * cells[i][3], -i))
    gap = [[abs(math.log(a / (w / h))) for _, _, w, h in cells] for a in aspects]
    cost = lambda p: round(sum(gap[x][c] for c, x in enumerate(p)) / len(cells) + (0.0 if p[largest] == hero else LARGEST_COST), 9)
    best = min(itertools.permutations(range(len(cells))), key=cost)
    return cost(best), best


def company(lead: dict, pool: list[dict], template: str, rules: Rules) -> list[dict]:
    """Items beside the lead, best first: near it in time, good enough, unlike it and each other, wide where the template is
    stacked. Empty if the cells can't all be filled."""
    liked = rules.preferred.get(template)
    worth = lambda x: x["score"] - (OTHER_KIND if liked and x["kind"] not in liked else 0.0)
    near = [x for x in pool if x["score"] >= LEAST_SCORE and abs(x["us"] - lead["us"]) <= NEAR_US and not (template in STACKED and x["aspect"] < WIDE)]
    held, need = [lead], len(TEMPLATES[template])
    for x in sorted(near, key=worth, reverse=True):
        if len(held) == need:
            break
        if all(((x["code"] ^ y["code"]) & (2**64 - 1)).bit_count() >= LEAST_BITS for y in held) and all(alike(x, y) <= MOST_LIKE for y in held):
            held.append(x)
    return held[1:] if len(held) == need else []


def alike(a: dict, b: dict) -> float:
    """Product of two items' unit vectors; 0 where one has none."""
    v, w = a.get("v"), b.get("v")
    return 0.0 if v is None or w is None else float(sum(x * y for x, y in zip(v, w)))


def plan(slides: list[dict], pool: list[dict], rules: Rules, before: dict[object, dict] | None = None) -> dict[object, tuple[str, list[dict]]]:
    """Template and items by the lead's id, for the slides (slide, item, solo) that become collages; the others stay single.

    before has the last plan by lead: chapter, template, ids. A collage of it whose items are free is taken over unchanged,
    so a second run makes the same post; one whose lead is now marked solo is not made up for on another slide. Then all
    wide leads and, up to what is left of the chapter's quota, the weakest upright ones get the cheapest template that
    companions can be found for."""
    lead = {s["item"]["id"]: s for s in slides}
    known = {x["id"]: x for x in [*pool, *(s["item"] for s in slides)]}
    used, times = set(lead), Counter()
    made: dict[object, tuple[str, list[dict]]] = {}
    upright = lambda x: x["aspect"] <= WIDE

    def settle(key: object, template: str, held: list[dict]) -> None:
        made[key] = template, held
        used.update(x["id"] for x in held)
        times[template] += 1

    def cheapest(item: dict) -> tuple[float, int, str, list[dict]] | None:
        free = [x for x in pool if x["chapter"] == item["chapter"] and x["id"] not in used]
        options = []
        for place, t in enumerate(rules.allowed.get(item["chapter"], ["grid"])):
            if times[t] < rules.most.get(t, math.inf) and (others := company(item, free, t, rules)):
                held = [item, *others]
                cost, order = order_cells([x["aspect"] for x in held], 0, t)
                options.append((cost + PLACE_COST * place + REPEAT_COST * times[t], place, t, [held[i] for i in order]))
        return min(options, key=lambda o: o[:2], default=None)

    for chapter in dict.fromkeys(s["item"]["chapter"] for s in slides):
        room = rules.quota.get(chapter, 0)
        for key, old in (before or {}).items():
            if old["chapter"] != chapter or old["template"] not in TEMPLATES or key not in lead:
                continue
            if lead[key]["solo"]:
                room -= 1
                continue
            held = [known.get(i) for i in old["items"]]
            if len(held) == len(TEMPLATES[old["template"]]) and all(x is not None and (x["id"] == key or x["id"] not in used) for x in held):
                settle(key, old["template"], held)
                room -= upright(lead[key]["item"])
        left = [s["item"] for s in slides if s["item"]["chapter"] == chapter and not s["solo"] and s["item"]["id"] not in made and (rules.first or s["slide"] != 1)]
        weakest = sorted(filter(upright, left), key=lambda x: x["strength"])
        for item in [x for x in left if not upright(x)] + weakest[: max(0, room)]:
            if found := cheapest(item):
                settle(item["id"], found[2], found[3])
    return made


def fixed_group(items: list[dict], wanted: str | None = None, allowed: list[str] | None = None) -> tuple[str, list[dict]] | None:
    """Template and order of items that belong together: the wanted template if it has as many cells, else the cheapest of
    that size, those not in the list of allowed ones at OUTSIDE. Stacked templates take upright items only where no other
    has that size. None if no template has."""
    hero = max(range(len(items)), key=lambda i: items[i]["score"])
    aspects = [x["aspect"] for x in items]
    sizes = [t for t, cells in TEMPLATES.items() if len(cells) == len(items)]
    if wanted in sizes:
        return wanted, [items[i] for i in order_cells(aspects, hero, wanted)[1]]
    fit = [t for t in sizes if t not in STACKED or min(aspects) > WIDE] or sizes
    place = lambda t: PLACE_COST * allowed.index(t) if t in (allowed or []) else OUTSIDE
    found = [(cost + place(t), n, t, order) for n, t in enumerate(fit) for cost, order in [order_cells(aspects, hero, t)]]
    _, _, template, order = min(found, default=(0.0, 0, None, ()))
    return (template, [items[i] for i in order]) if template else None


def plan_albums(df: DataFrame, rules: Rules, album: str = "album") -> DataFrame:
    """df (album, item_id, chapter, us, aspect, kind, score, strength, code, slide or null, solo): album, slide, template or
    null, items for every slide. Rows without a slide are the pool. An album's plan is one task, which gets its numbers."""
    kind, key = df.schema[album].dataType.simpleString(), df.schema["item_id"].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["us", "id"])
        all_items = rows[["id", "chapter", "us", "aspect", "kind", "score", "strength", "code"]].to_dict("records")
        slides = sorted(({"slide": int(n), "item": x, "solo": bool(o)} for x, n, o in zip(all_items, rows["slide"], rows["solo"]) if pd.notna(n)), key=lambda s: s["slide"])
        made = plan(slides, [x for x, n in zip(all_items, rows["slide"]) if pd.isna(n)], rules)
        out = [(s["slide"], *made.get(s["item"]["id"], (None, [s["item"]]))) for s in slides]
        frame = pd.DataFrame({"slide": [n for n, _, _ in out], "template": pd.Series([t for _, t, _ in out], dtype=object), "items": [[x["id"] for x in held] for _, _, held in out]})
        return frame.assign(album=rows["album"].iloc[0])[["album", "slide", "template", "items"]]

    small = df.select(F.col(album).alias("album"), F.col("item_id").alias("id"), "chapter", "us", "aspect", "kind", "score", "strength", "code", "slide", "solo")
    return small.groupBy("album").applyInPandas(solve, f"album {kind}, slide long, template string, items array<{key}>").withColumnRenamed("album", album)
