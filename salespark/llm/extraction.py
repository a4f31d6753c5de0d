"""Main text of web pages: gradient-boosted trees over features of DOM nodes, and a decoding along the tree.

Each element gets features: what kind it is, which name tokens it and its ancestors carry, text and link density of its
subtree, depth, place in the page and in comparison with its siblings. Boosted trees (MLlib's, fitted on `PAGES`
made-up pages of known main text, see `layouts`) give the log-odds that an element holds main text. Single verdicts
could contradict each other, so they are decoded together: an element can be kept only if its parent is, and the
kept part of the tree is the one with the largest sum of log-odds, found in one pass from the leaves to the root. A
menu entry that looks like text goes with its menu, and a short paragraph stays with its article.

Pages are independent: one pass over the table in Arrow batches, nothing is shuffled. What tasks are sent is the
model, some hundred numbers per tree.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespark.llm.layouts import MARK, NAMES, Maker
from salespark.llm.markup import BLOCKS, HEADINGS, UNSEEN, Page, kept_text, read_page
from salespark.session import shared_folder, ship_package, stage

PAGES = 1000  # made-up pages that the model is fitted on
TREES, DEPTH, STEP = 20, 6, 0.4
SEED = 13

_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SETS = {kind: frozenset(t for name in names for t in name.split("-")) | frozenset(names) for kind, names in NAMES.items()}
_KINDS = list(_SETS)
_GROUPS = [
    HEADINGS, {"p", "pre", "blockquote"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"a"},
    {"article", "main"}, {"div", "section", "body", "#page", "html"}, {"nav"}, {"footer"}, {"aside", "dialog"}, {"header"}, {"ins"},
    {"form", "button", "label", "fieldset", "legend", "input", "option"}, {"figure", "figcaption"}, {"#text"},
]
_GROUP_OF = {tag: i for i, group in enumerate(_GROUPS) for tag in group}
_FAR, _ARTICLE = 30.0, _GROUP_OF["article"]
_NO_KINDS, _NOTHING_ABOVE = [0] * len(_KINDS), [_FAR] * (len(_KINDS) + len(_GROUPS))
_MAIN = [_KINDS.index("main")] + [len(_KINDS) + _GROUP_OF["article"]]
_OTHER = [i for i, kind in enumerate(_KINDS) if kind != "main"] + [len(_KINDS) + _GROUP_OF[tag] for tag in ("nav", "footer", "aside", "ins", "form")]


def name_kinds(attributes: dict[str, str]) -> list[int]:
    """Per kind of part: whether class, id or role names it."""
    said = " ".join(attributes.get(a, "") for a in ("class", "id", "role", "itemprop", "aria-label"))
    if not said.strip():
        return [0] * len(_KINDS)
    whole = {t for t in re.split(r"[\s_]+", said.lower()) if t}
    tokens = whole | {t.lower() for t in _TOKEN.findall(said)}
    return [int(bool(tokens & _SETS[kind])) for kind in _KINDS]


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "hidden" in attributes or "display:none" in style or "visibility:hidden" in style


def features(page: Page) -> tuple[np.ndarray, list[bool], list[bool]]:
    """One row per element; whether its subtree has text; whether it is never shown."""
    size = len(page.tags)
    parents, tags = page.parents, page.tags
    chars, words, stops, blocks = [0] * size, [0] * size, [0] * size, [0] * size
    starts, order = [-1] * size, 0
    for node, text in page.pieces:
        if text is None:
            continue
        cut = text.split()
        if not cut:
            continue
        n = sum(map(len, cut))
        if starts[node] < 0:
            starts[node] = order
        order += n
        chars[node] += n
        words[node] += len(cut)
        stops[node] += sum(1 for w in cut if w[-1] in ".,;:!?…。،")
    children: list[list[int]] = [[] for _ in range(size)]
    depth, unseen = [0] * size, [False] * size
    kinds = [name_kinds(attributes) if attributes else _NO_KINDS for attributes in page.attributes]
    group = [_GROUP_OF.get(tag, len(_GROUPS)) for tag in tags]
    beneath: list[list[float]] = [[]] * size  # steps up from a child to the nearest ancestor of each kind and group
    above = [_NOTHING_ABOVE] * size
    for i in range(1, size):  # parents come before their children
        parent = parents[i]
        if not children[parent]:
            far = [x + 1 if x < _FAR else _FAR for x in above[parent]]
            for k, has in enumerate(kinds[parent]):
                if has:
                    far[k] = 1.0
            if group[parent] < len(_GROUPS):
                far[len(_KINDS) + group[parent]] = 1.0
            beneath[parent] = far
        above[i] = beneath[parent]
        children[parent].append(i)
        depth[i] = depth[parent] + 1
        unseen[i] = unseen[parent] or tags[i] in UNSEEN or bool(page.attributes[i]) and _hidden(page.attributes[i])
    links, inner, has_main = [0] * size, [1] * size, [0] * size
    for i in range(size - 1, 0, -1):
        if unseen[i]:
            chars[i] = words[i] = stops[i] = 0
        if tags[i] == "a":
            links[i] = chars[i]
        if group[i] == _ARTICLE:
            has_main[i] = 1
        if chars[i] and not any(blocks[c] or tags[c] in BLOCKS for c in children[i]):
            blocks[i] = 1
        parent = parents[i]
        chars[parent] += chars[i]
        words[parent] += words[i]
        stops[parent] += stops[i]
        links[parent] += links[i]
        inner[parent] += inner[i]
        blocks[parent] += blocks[i]
        has_main[parent] |= has_main[i]
        if starts[i] >= 0 and (starts[parent] < 0 or starts[i] < starts[parent]):
            starts[parent] = starts[i]
    total, everywhere = max(chars[0], 1), math.log1p(order)
    density = [links[i] / chars[i] if chars[i] else 0.0 for i in range(size)]
    logs = [math.log1p(n) for n in chars]
    named = [max(k) for k in kinds]
    made: list[list[float]] = [[]] * size

    def describe(parent: int, brothers: list[int]) -> None:
        alike, most, names = Counter(tags[b] for b in brothers), max(max(chars[b] for b in brothers), 1), sum(named[b] for b in brothers)
        after, following = -1, []
        for b in reversed(brothers):
            following.append(after)
            after = b if chars[b] else after
        before, whole, count = -1, max(chars[parent], 1), len(brothers)
        for at, (i, after) in enumerate(zip(brothers, reversed(following), strict=True)):
            n, w, b = chars[i], max(words[i], 1), max(blocks[i], 1)
            made[i] = [
                logs[i], math.log1p(words[i]), density[i], stops[i] / w, n / w, n / inner[i], n / b, math.log1p(blocks[i]), math.log1p(inner[i]), n / total,
                max(starts[i], 0) / max(order, 1), depth[i], at, count, alike[tags[i]] / count, n / whole, n / most,
                logs[before] if before >= 0 else -1, density[before] if before >= 0 else -1, group[before] if before >= 0 else -1,
                logs[after] if after >= 0 else -1, density[after] if after >= 0 else -1, group[after] if after >= 0 else -1,
                density[parent], logs[parent], everywhere, has_main[i], has_main[0] and not has_main[i], sum(kinds[i]), names > named[i],
            ]
            before = i if n else before

    describe(0, [0])
    for parent, brothers in enumerate(children):
        if brothers:
            describe(parent, brothers)
    far, own = np.array(above), np.zeros((size, len(_KINDS) + len(_GROUPS)), bool)
    own[:, : len(_KINDS)] = kinds
    inside = np.flatnonzero(np.array(group) < len(_GROUPS))
    own[inside, len(_KINDS) + np.array(group)[inside]] = True
    reach = np.where(own, 0.0, far)  # with the element's own kinds and group, at no distance
    main, other = reach[:, _MAIN].min(axis=1), reach[:, _OTHER].min(axis=1)
    rows = np.column_stack([np.array(made, np.float64), main, other, other - main, own, far])
    return rows, [c > 0 for c in chars], unseen


@dataclass
class Trees:
    """Boosted trees as arrays: per tree and node the feature (-1: leaf), threshold, children and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(len(self.feature)):
            at = np.zeros(len(rows), np.int32)
            for _ in range(self.depth):
                feature = self.feature[t][at]
                inner = feature >= 0
                lower = rows[every, np.where(inner, feature, 0)] <= self.threshold[t][at]
                at = np.where(inner, np.where(lower, self.left[t][at], self.right[t][at]), at)
            total += self.value[t][at]
        return 2 * total  # MLlib's margin is half the log-odds


def made_pages(start: int, stop: int) -> Iterator[str]:
    for seed in range(start, stop):
        yield Maker(seed).page()


def labelled(html: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Features and labels (1: holds main text) of the elements with text of a made-up page, and its main text."""
    page = read_page(html)
    marked = [False] * len(page.tags)
    for node, text in page.pieces:
        if text and MARK in text:
            while node >= 0 and not marked[node]:
                marked[node], node = True, page.parents[node]
    wanted = kept_text(Page(page.tags, page.parents, page.attributes, [(n, t) for n, t in page.pieces if t is None or MARK in t or not t.strip()]), marked)
    page.pieces = [(node, text and text.replace(MARK, "")) for node, text in page.pieces]
    rows, filled, unseen = features(page)
    use = np.array(filled) & ~np.array(unseen)
    return rows[use], np.array(marked)[use], wanted.replace(MARK, "")


def learn(spark: SparkSession, pages: int = PAGES, trees: int = TREES) -> Trees:
    """Trees fitted on made-up pages; the same for the same arguments."""
    ship_package(spark)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (html,) in zip(batch.column("html").to_pylist(), strict=True):
                rows, marks, _ = labelled(html)
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), pa.array(marks.astype(float))], names=["x", "label"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Maker(seed).page() for seed in batch.column("id").to_pylist()])], names=["html"])

    made = spark.range(0, pages, 1, 8).mapInArrow(make, "html string")
    rows = stage(made.mapInArrow(answer, "x array<double>, label double"), "extraction-training")
    model = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=STEP, seed=SEED, maxBins=64).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    path = f"{shared_folder(spark).rstrip('/')}/salespark/extraction-model-{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # at most 2^(DEPTH+1) per tree
    shape = (trees, max(n["id"] for n in nodes) + 1)
    out = Trees(np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape), DEPTH)
    for n in nodes:
        at = n["treeID"], n["id"]
        out.value[at] = n["prediction"] * model.treeWeights[n["treeID"]]
        if n["leftChild"] >= 0:
            out.feature[at], out.threshold[at] = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            out.left[at], out.right[at] = n["leftChild"], n["rightChild"]
    return out


def decode(parents: list[int], odds: np.ndarray) -> list[bool]:
    """The elements of the best part of the tree: closed towards the root, with the largest sum of log-odds.

    An element's parent must come before it, or be given a smaller index.
    """
    best = odds.astype(float).tolist()
    for i in range(len(parents) - 1, 0, -1):
        if best[i] > 0:
            best[parents[i]] += best[i]
    kept = [best[0] > 0]
    for i in range(1, len(parents)):
        kept.append(best[i] > 0 and kept[parents[i]])
    return kept


def main_texts(pages: list[str | None], model: Trees) -> list[str]:
    read = [read_page(html) for html in pages]
    told = [features(page) for page in read]
    odds = model.log_odds(np.concatenate([rows for rows, _, _ in told])) if told else np.empty(0)
    out, at = [], 0
    for page, (rows, filled, unseen) in zip(read, told, strict=True):
        own = np.where(np.array(filled), odds[at : at + len(rows)], -1e-9)  # an element without text decides nothing
        own[np.array(unseen)] = -1e9
        at += len(rows)
        out.append(kept_text(page, decode(page.parents, own)))
    return out


def extract_main_text(pages: DataFrame, model: Trees, group: int = 256) -> DataFrame:
    """pages with the columns text and n_chars (its code points) in place of html; other columns are kept.

    The text holds the article's blocks in page order, without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and readers' comments; white space inside is one space, and one space joins blocks. Null,
    empty and text-free pages have an empty text. Columns named text or n_chars before are replaced.
    """
    ship_package(pages.sparkSession)
    own = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, group):
                part = batch.slice(start, group)
                texts = main_texts(part.column("html").to_pylist(), model)
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *made], names=[*own, "text", "n_chars"])

    kept = pages.select(*[F.col(f"`{c}`") for c in own], "html")
    return kept.mapInArrow(answer, kept.drop("html").schema.add("text", "string").add("n_chars", "long"))
