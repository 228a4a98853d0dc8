"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Each page becomes the sequence of its leaf blocks (``html_blocks``).  A block has binary features
of its ancestors (element names, what their classes and ids hint at) and of its text (length,
links, punctuation, form).  The field has a weight for each feature and label and a transition
weight for each pair of labels, told apart by whether two neighbours share their parent.  It is
trained on labelled pages by gradient ascent of the penalised likelihood, with forward-backward
over all training pages at once, and decodes by Viterbi.

Training sees a bounded number of pages (``TRAINING_PAGES``) and takes seconds; the weights are
broadcast.  Decoding is per row, without a shuffle.

Defined results: a null or empty page, or one without article text, gives the empty text;
repeated rows give equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lowtide.llm.html_blocks import Block, blocks
from lowtide.llm.html_training import MAIN, training_pages
from lowtide.llm.storage import bounded_batches
from lowtide.llm.text import slices

TRAINING_PAGES, ROUNDS, PENALTY = 600, 120, 0.02

#: what classes, ids and roles hint at
HINTS = {
    "menu": r"\bnav|menu|breadcrumb|pagin|pager|\btoc\b|\btabs?\b|toolbar|\btags?\b|share|social|related|more-?links|skip",
    "header": r"header|masthead|topbar|\blogo|\bbrand|branding",
    "footer": r"foot|copyright|colophon|legal|imprint",
    "sidebar": r"side-?bar|\brail\b|-rail|aside|widget|promo|complementary|\bside\b|recommend|trending|popular",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|dialog|toast|newsletter|paywall|disclaimer|banner",
    "advert": r"\bads?\b|\bads?[-_]|[-_]ads?\b|advert|sponsor|adsbox|adslot|ad-?slot|dfp|promoted|commercial",
    "form": r"form\b|search|login|sign-?up|subscribe|contact-us|input",
    "comments": r"comment|disqus|repl(?:y|ies)\b|respon[ds]|discussion|review|feedback|\bthread",
    "content": r"article|content|\bpost|entry|story|\bmain\b|main-|\btext\b|-text|\bbody\b|-body|prose",
}
_HINTS = {name: re.compile(pattern) for name, pattern in HINTS.items()}
ANCESTORS = (
    "article main section nav header footer aside form fieldset dialog table td th ul ol li dl p blockquote pre figure "
    "figcaption h1 h2 h3 h4 h5 h6 button label details address"
).split()
FEATURES = (
    ["always"]
    + [f"in:{x}" for x in ANCESTORS]
    + [f"is:{x}" for x in ANCESTORS]
    + [f"hint:{x}" for x in HINTS]
    + [f"near:{x}" for x in HINTS]
    + ["words:1", "words:2", "words:4", "words:9", "words:19", "words:49", "words:more"]
    + ["links:none", "links:some", "links:most"]
    + ["stop", "comma", "copyright", "bar", "digits", "shouting", "lower", "symbols", "first", "last"]
    + ["article>aside", "article>nav", "article>form", "article>footer", "article>header", "content>bad", "bad>content", "plain"]
)
_NUMBER = {name: i for i, name in enumerate(FEATURES)}
_DIGITS = re.compile(r"\d")
BAD = ("menu", "header", "footer", "sidebar", "notice", "advert", "form", "comments")


def _hinted(hints: str, known: dict[str, frozenset] = {}) -> frozenset:  # noqa: B006  (a cache)
    if hints not in known:
        if len(known) > 100_000:
            known.clear()
        known[hints] = frozenset(k for k, p in _HINTS.items() if p.search(hints)) if hints else frozenset()
    return known[hints]


def _path_features(block: Block) -> list[str]:
    names = [n.name for n in block.path]
    hints = [_hinted(n.hints) for n in block.path]
    found = [f"in:{x}" for x in set(names) if f"in:{x}" in _NUMBER]
    if names and f"is:{names[-1]}" in _NUMBER:
        found.append(f"is:{names[-1]}")
    found += [f"hint:{x}" for x in frozenset().union(*hints)]
    # the innermost element that hints at anything
    found += [f"near:{x}" for x in next((h for h in reversed(hints) if h), ())]
    for outer in ("article", "main"):
        if outer in names:
            inner = names[names.index(outer) + 1 :]
            found += [f"article>{x}" for x in ("aside", "nav", "form", "footer", "header") if x in inner]
            break
    content = [i for i, (n, h) in enumerate(zip(names, hints)) if "content" in h or n in ("article", "main")]
    bad = [i for i, (n, h) in enumerate(zip(names, hints)) if any(x in h for x in BAD) or n in ("nav", "aside", "form", "footer")]
    if content and bad:
        found.append("content>bad" if max(bad) > max(content) else "bad>content")
    if not content and not bad:
        found.append("plain")
    return found


def _text_features(block: Block) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    found = ["always", "words:" + next((str(k) for k in (1, 2, 4, 9, 19, 49) if n <= k), "more")]
    share = block.linked / max(block.chars, 1)
    found.append("links:none" if not block.linked else "links:some" if share < 0.5 else "links:most")
    if text[-1] in ".!?…\"”»":
        found.append("stop")
    if "," in text:
        found.append("comma")
    if "©" in text or "(c)" in text:
        found.append("copyright")
    if "|" in text or "»" in text or "·" in text:
        found.append("bar")
    if 4 * len(_DIGITS.findall(text)) > len(text):
        found.append("digits")
    if text.isupper():
        found.append("shouting")
    if text[0].islower():
        found.append("lower")
    if 20 * sum(map(text.count, "#*$%&<>")) > len(text):
        found.append("symbols")
    return found


@dataclass
class Sequence:
    """One page: features of its blocks, and whether each shares its parent with the one before."""

    features: list[list[int]]
    shared: list[int]


def sequence(page: list[Block], paths: dict | None = None) -> Sequence:
    features, shared, last = [], [], None
    paths = {} if paths is None else paths
    for block in page:
        key = tuple((n.name, n.hints) for n in block.path)
        if key not in paths:
            if len(paths) > 100_000:
                paths.clear()
            paths[key] = [_NUMBER[x] for x in _path_features(block)]
        features.append(paths[key] + [_NUMBER[x] for x in _text_features(block)])
        parent = tuple(map(id, block.path[:-1]))
        shared.append(int(parent == last))
        last = parent
    if features:
        features[0] = [*features[0], _NUMBER["first"]]
        features[-1] = [*features[-1], _NUMBER["last"]]
    return Sequence(features, shared)


@dataclass
class Field:
    """Weights of the two labels (0 furniture, 1 article) for features, and of label pairs."""

    weights: np.ndarray  # features x 2
    pairs: np.ndarray  # shared or not x before x after

    def decode(self, page: Sequence) -> list[int]:
        """The likeliest labels of a page (Viterbi)."""
        if not page.features:
            return []
        weights = self.weights
        scores = [weights[f].sum(axis=0) for f in page.features]
        pairs = self.pairs.tolist()
        a, b = scores[0].tolist()
        back = []
        for (x, y), s in zip((v.tolist() for v in scores[1:]), page.shared[1:]):
            (p00, p01), (p10, p11) = pairs[s]
            back.append((int(b + p10 > a + p00), int(b + p11 > a + p01)))
            a, b = x + max(a + p00, b + p10), y + max(a + p01, b + p11)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[Sequence], labels: list[list[int]], rounds: int = ROUNDS, penalty: float = PENALTY) -> Field:
    """Weights that maximise the penalised log likelihood, by Adam on the full gradient."""
    pages, labels = zip(*[(p, y) for p, y in zip(pages, labels) if p.features])
    n, longest = len(pages), max(len(p.features) for p in pages)
    x = np.zeros((n, longest, len(FEATURES)))
    mask = np.zeros((n, longest), bool)
    shared = np.zeros((n, longest), int)
    gold = np.zeros((n, longest), int)
    for i, (p, y) in enumerate(zip(pages, labels)):
        for t, f in enumerate(p.features):
            x[i, t, f] = 1
        mask[i, : len(y)], shared[i, : len(y)], gold[i, : len(y)] = True, p.shared, y
    total = mask.sum()
    inner = mask[:, 1:]
    flat = x.reshape(-1, len(FEATURES))
    gold_x = flat.T @ np.stack([(gold == k) & mask for k in (0, 1)], axis=-1).reshape(-1, 2)
    gold_pairs = np.zeros((2, 2, 2))
    np.add.at(gold_pairs, (shared[:, 1:][inner], gold[:, :-1][inner], gold[:, 1:][inner]), 1)
    weights, pairs = np.zeros((len(FEATURES), 2)), np.zeros((2, 2, 2))
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (weights, pairs)]
    for step in range(1, rounds + 1):
        score = x @ weights
        edge = pairs[shared]  # page x place x before x after
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + edge[:, t], axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        norm = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(edge[:, t + 1] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        single = np.exp(forward + backward - norm[:, None, None]) * mask[..., None]
        both = forward[:, :-1, :, None] + edge[:, 1:] + (score + backward)[:, 1:, None, :] - norm[:, None, None, None]
        both = np.exp(np.minimum(both, 0)) * inner[..., None, None]
        expected = np.stack([both[shared[:, 1:] == s].sum(axis=0) for s in (0, 1)])
        gradients = (
            (gold_x - flat.T @ single.reshape(-1, 2)) / total * 10 - penalty * weights,
            (gold_pairs - expected) / total * 10 - penalty * pairs,
        )
        for value, gradient, (m, v) in zip((weights, pairs), gradients, state):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(weights, pairs)


def labelled(pages: list[str]) -> tuple[list[Sequence], list[list[int]]]:
    """Sequences and labels of pages whose article texts begin with the mark."""
    found, labels = [], []
    for page in pages:
        parsed = blocks(page)
        labels.append([int(MAIN in b.text) for b in parsed])
        for b in parsed:
            b.text = b.text.replace(MAIN, "") or "."
        found.append(sequence(parsed))
    return found, labels


def trained(pages: int = TRAINING_PAGES) -> Field:
    """The field trained on the labelled pages."""
    return train(*labelled(training_pages(pages)))


def main_text(page: str, field: Field, paths: dict | None = None) -> str:
    """The article of a page: its blocks in order, joined by one space."""
    parsed = blocks(page)
    labels = field.decode(sequence(parsed, paths))
    return " ".join(b.text for b, label in zip(parsed, labels) if label)


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", field: Field | None = None
) -> DataFrame:
    """One row per page: key, url, the main text and its number of characters."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict = {}
        for batch in slices(batches, "_html"):
            texts = [main_text(x or "", shared.value, paths) for x in batch.column("_html").to_pylist()]
            columns = [batch.column("_key"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, url, "text", "n_chars"])

    rows = pages.select(pages[key].alias("_key"), pages[url].alias("_url"), pages[html].alias("_html"))
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
