"""Personal data: spans by fixed rules, and more of them by boosted trees over loose candidates.

Base spans come from one rule a kind (``base_spans``). Beside them, generators of high recall
propose overlapping spans: addresses written with "at" and "dot", dotted numbers with blanks or
brackets, and every stretch of up to six groups of digits with 7 to 19 digits. Gradient boosted
trees score each by its format (digits, groups, separators, check digit) and context (neighbours,
cue words before it). Those at or above their kind's threshold are taken, the best first, where
they overlap nothing taken before; base spans always stay.

Training: there are no labelled spans, so labels are made from the base rules on all documents.
Base spans are examples, other candidates are counterexamples, and in place of each base span other
ways to write it (examples) and look-alikes such as dates, versions and numbers that fail their
check digit (counterexamples) are scored in its context. A quarter of the documents, by hash, is
held out: an isotonic regression over all its scores gives the threshold, the least score whose
calibrated share of examples reaches ``PRECISION``. A kind with fewer than ``LEAST_HELD`` held-out
examples there, or a table without base spans, gets base spans only.

Scale: equal rows of features are counted, by one shuffle, and MLlib trains the trees on the
distinct ones with their counts as weights. ``BINS`` is so large that it takes the cuts it tries
from all of up to a million distinct rows; of more it draws a million for the cuts, while trees and
leaves still see all rows. Thresholds go by scores to ``DIGITS_OF_SCORES`` digits, so what the
regression brings to the driver does not grow with the table. The trees are then a few arrays of
bounded size; all documents go through one more pass without a shuffle, in which every rule takes
time in proportion to the text. Null texts are empty; every row of the input gives a row, so null and repeated ids stay
as they are. Columns other than ``doc_id`` and ``text`` are ignored. Offsets are code points.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, materialise, rows_of

HELD_OUT, PRECISION, LEAST_HELD = 4, 0.95, 20
TREES, DEPTH, BINS = 20, 4, 1024
ROWS_PER_TASK, DIGITS_OF_SCORES = 20_000, 4
CONTEXT = 40

# The kinds in their order, the base patterns, and the words that tell of a kind or
# of a number that is no personal data.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CUES = (
    "mail contact write reach inbox",
    "ip host server address login client",
    "card visa mastercard amex credit debit payment",
    "tel phone call fax mobile cell sms whatsapp",
    "order invoice isbn version release build page ref sku lot date year total price id",
)
# How an address may be written: what stands between its name and host, and within its host.
AT = re.compile(r"@|[\[({] ?at ?[\])}]| at ", re.IGNORECASE)
HOST = re.compile(
    r" ?[A-Za-z0-9-]+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]+)+", re.IGNORECASE
)
NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
DOTTED = re.compile(
    r"(?<![0-9])[0-9]{1,3}(?:(?: ?[\[(] ?(?:\.|dot) ?[\])] ?| ?\. ?)[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE
)
DIGITS = re.compile(r"[0-9]+")
BETWEEN_GROUPS = re.compile(r"[ ./()-]{1,3}\Z")
MOST_GROUPS, FEWEST_DIGITS, MOST_DIGITS = 6, 7, 19

FEATURES = (
    "is_email is_ip is_card is_phone length digits groups first_group last_group longest_group "
    "blanks hyphens dots slashes brackets plus check_digit octets at_sign at_word dot_word last_part "
    "letter_before letter_after mark_before mark_after cue_email cue_ip cue_card cue_phone cue_other"
).split()


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules, by kind and start."""
    spans = [Span(0, start, end) for start, end in _emails(text)]
    if _has_digit(text):
        spans += [Span(1, *found.span()) for found in IP.finditer(text) if _octets(found[0].split("."))]
        spans += [Span(2, *found.span()) for found in CARD.finditer(text) if _is_card(found[0])]
        spans += [Span(3, *found.span()) for found in PHONE.finditer(text) if 8 <= _digits(found[0]) <= 15]
    return spans


def _has_digit(text: str) -> bool:
    return DIGITS.search(text) is not None


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of name, sign and domain, found from the signs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _digits(text: str) -> int:
    return sum(map(len, DIGITS.findall(text)))


def _octets(parts: list[str]) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in parts)


def _is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def luhn(digits: str) -> bool:
    values = list(map(int, reversed(digits)))
    return (sum(values[::2]) + sum(sum(divmod(2 * one, 10)) for one in values[1::2])) % 10 == 0


def candidates(text: str) -> list[Span]:
    """Loose spans, overlapping ones among them."""
    found = set(_loose_emails(text))
    if _has_digit(text):
        found.update(Span(1, *one.span()) for one in DOTTED.finditer(text))
        found.update(_loose_numbers(text))
    return sorted(found)


def _loose_emails(text: str) -> Iterator[Span]:
    for at in AT.finditer(text):
        host = HOST.match(text, at.end())
        name = NAME_BEFORE.search(text[max(0, at.start() - 65) : at.start()]) if host else None
        if name:
            yield Span(0, at.start() - len(name[0]), host.end())


def _loose_numbers(text: str) -> Iterator[Span]:
    """Stretches of groups of digits, as cards and as phone numbers."""
    run: list[tuple[int, int]] = []
    for group in DIGITS.finditer(text):
        if run and not BETWEEN_GROUPS.match(text[run[-1][1] : min(group.start(), run[-1][1] + 4)]):
            run.clear()
        run.append(group.span())
        del run[:-MOST_GROUPS]
        digits = 0
        for start, end in reversed(run):
            digits += end - start
            if digits > MOST_DIGITS:
                break
            if digits >= FEWEST_DIGITS:
                first = start
                while first > 0 and text[first - 1] in "(+" and start - first < 2:
                    first -= 1
                if digits >= 13:
                    yield Span(2, start, group.end())
                if digits <= 15:
                    yield Span(3, first, group.end())


def features(text: str, span: Span) -> list[float]:
    """What the trees see of a candidate, in the order of ``FEATURES``."""
    kind, start, end = span
    own = text[start:end]
    lower = own.lower()
    groups = DIGITS.findall(own)
    sizes = list(map(len, groups)) or [0]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + 1]
    words = re.findall(r"[a-z]+", before)
    last = before[-1:]
    return [
        *[float(kind == at) for at in range(len(KINDS))],
        len(own),
        sum(sizes),
        len(groups),
        sizes[0],
        sizes[-1],
        max(sizes),
        own.count(" "),
        own.count("-"),
        own.count("."),
        own.count("/"),
        own.count("(") + own.count("["),
        float("+" in own),
        float(sum(sizes) >= 13 and luhn("".join(groups))),
        float(len(groups) == 4 and _octets(groups)),
        float("@" in own),
        float(bool(re.search(r"\bat\b", lower))),
        float(bool(re.search(r"\bdot\b", lower))),
        len(re.split(r"[^A-Za-z0-9-]+", own)[-1]),
        float(last.isalnum()),
        float(after.isalnum()),
        float(last in tuple("\"'#=/.-:$€")),
        float(after in tuple("\"'%/-:$€")),
        *[float(any(word in cues.split() for word in words[-4:])) for cues in CUES],
    ]


class Trees:
    """A trained ensemble as arrays, and the threshold of each kind."""

    def __init__(self, trees: list[list[tuple[int, float, int, int]]], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds
        size = max(map(len, trees), default=1)
        nodes = np.zeros((len(trees), size, 4))
        for at, tree in enumerate(trees):
            nodes[at, : len(tree)] = tree
        self.feature, self.value = nodes[..., 0].astype(int), nodes[..., 1]
        self.left, self.right = nodes[..., 2].astype(int), nodes[..., 3].astype(int)

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        """The weighted sum of the trees' leaves for each row of features."""
        values = np.array(rows).reshape(len(rows), len(FEATURES))
        of_row, tree = np.arange(len(rows))[:, None], np.arange(len(self.trees))[None, :]
        at = np.zeros((len(rows), len(self.trees)), int)
        for _ in range(DEPTH):
            feature = self.feature[tree, at]
            inner = feature >= 0
            goes_left = values[of_row, np.maximum(feature, 0)] <= self.value[tree, at]
            at = np.where(inner, np.where(goes_left, self.left[tree, at], self.right[tree, at]), at)
        return self.value[tree, at].sum(axis=1)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The candidates to take beside the base spans."""
        if min(self.thresholds) == np.inf:
            return []
        open_ = [one for one in candidates(text) if self.thresholds[one.kind] < np.inf]
        open_ = _apart(open_, base)
        if not open_:
            return []
        scores = self.scores([features(text, one) for one in open_])
        # Leaves are added up in one order, so that equal candidates have equal scores.
        ranked = sorted(zip(np.round(-scores, 9).tolist(), open_))
        wanted = [span for score, span in ranked if judged(-score) >= self.thresholds[span.kind]]
        taken = _Taken()
        return sorted(span for span in wanted if taken.add(span))


def judged(scores):
    """Scores as thresholds know them."""
    return np.round(scores, DIGITS_OF_SCORES)


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap none of the base spans."""
    taken = _Taken()
    for one in base:
        taken.add(one, force=True)
    return [span for span in spans if taken.is_free(span)]


class _Taken:
    """Parts of a text that are spoken for, by blocks of 64 code points."""

    def __init__(self):
        self.blocks: dict[int, list[Span]] = {}

    def is_free(self, span: Span) -> bool:
        return not any(
            span.start < other.end and other.start < span.end
            for block in range(span.start >> 6, (span.end - 1 >> 6) + 1)
            for other in self.blocks.get(block, ())
        )

    def add(self, span: Span, force: bool = False) -> bool:
        free = force or self.is_free(span)
        if free:
            for block in range(span.start >> 6, (span.end - 1 >> 6) + 1):
                self.blocks.setdefault(block, []).append(span)
        return free


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) for each document: arrays of (kind, start, end), kinds by number."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    trees = train(narrow)
    spans = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("base", spans), ("added", spans)])

    def search(batches):
        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                base = base_spans(text)
                yield doc, list(map(list, base)), list(map(list, trees.added(text, base)))

        yield from batches_of(rows(), schema)

    return narrow.mapInArrow(search, "doc_id long, base array<array<long>>, added array<array<long>>")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda span: F.concat_ws(
        ":", F.get(kinds, span[0].cast("int")), span[1].cast("string"), span[2].cast("string")
    )
    return F.array_join(F.transform(spans, one), ",")


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping ones become one."""
    parts, free = [], 0
    for kind, start, end in sorted(spans, key=lambda span: (span[1], span[2])):
        if start >= free:
            parts += [text[free:start], f"[{KINDS[kind]}]"]
        free = max(free, end)
    return "".join(parts) + text[free:]


# -- training --------------------------------------------------------------------------


def train(docs: DataFrame) -> Trees:
    """Trees and thresholds from the base rules on all documents."""
    nothing = Trees([], [np.inf] * len(KINDS))
    fields = "kind int, label double, held boolean, features array<double>"
    rows = docs.mapInArrow(_examples, fields).groupBy("kind", "label", "held", "features")
    rows = materialise(rows.agg(F.count("*").cast("double").alias("weight")), "examples")
    fit_on = rows.where("NOT held")
    counts = fit_on.agg(F.max("label"), F.min("label"), F.count("*")).first()
    if not counts[0] or counts[1]:
        return nothing
    tasks = max(1, counts[2] // ROWS_PER_TASK)
    vectors = fit_on.select("label", "weight", array_to_vector("features").alias("features")).coalesce(tasks)
    booster = GBTClassifier(
        maxIter=TREES,
        maxDepth=DEPTH,
        maxBins=BINS,
        stepSize=0.2,
        seed=1,
        checkpointInterval=-1,
        weightCol="weight",
    )
    model = booster.fit(vectors)
    trees = Trees(
        [_nodes(tree, weight) for tree, weight in zip(model.trees, model.treeWeights)],
        [np.inf] * len(KINDS),
    )
    fields = "kind int, label double, score double, weight double"
    held = rows.where("held").mapInArrow(_scored(trees), fields).groupBy("kind", "label", "score")
    held = materialise(held.agg(F.sum("weight").alias("weight")), "held")
    examples = held.where("label = 1").groupBy("kind").agg(F.sum("weight").alias("n"))
    examples = {row.kind: row.n for row in examples.collect()}
    for kind in range(len(KINDS)):
        if examples.get(kind, 0) >= LEAST_HELD:
            trees.thresholds[kind] = _threshold(held.where(F.col("kind") == kind))
    return trees


def _nodes(tree, weight: float) -> list[tuple[int, float, int, int]]:
    """A tree as (feature, threshold, left, right) rows; leaves have feature -1 and their value."""
    nodes: list[tuple[int, float, int, int]] = []

    def add(node) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if node.getClass().getSimpleName() == "LeafNode":
            nodes[at] = (-1, weight * node.prediction(), 0, 0)
        else:
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right)
        return at

    add(tree._call_java("rootNode"))
    return nodes


def _scored(trees: Trees):
    def score(batches):
        for batch in batches:
            values = trees.scores(batch.column("features").to_pylist())
            columns = [batch.column("kind"), batch.column("label"), pa.array(judged(np.round(values, 9)))]
            columns.append(batch.column("weight"))
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "label", "score", "weight"])

    return score


def _threshold(held: DataFrame) -> float:
    """The least score from which on the calibrated share of examples is ``PRECISION``."""
    model = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(held)
    pairs = zip(model.boundaries.toArray(), model.predictions.toArray())
    return float(min((score for score, share in pairs if share >= PRECISION), default=np.inf))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled candidates of documents, and of what is put in place of base spans."""
    schema = pa.schema(
        [("kind", pa.int32()), ("label", pa.float64()), ("held", pa.bool_()), ("features", pa.list_(pa.float64()))]
    )

    def rows():
        for text in (text for _, text in rows_of(batches, "doc_id", "text")):
            held = zlib.crc32(text.encode()) % HELD_OUT == 0
            base = base_spans(text)
            known = set(base)
            for span in known.intersection(candidates(text)):
                yield span.kind, 1.0, held, features(text, span)
            for span in _apart(candidates(text), base):
                yield span.kind, 0.0, held, features(text, span)
            for span in base:
                before = text[max(0, span.start - 2 * CONTEXT) : span.start]
                after = text[span.end : span.end + CONTEXT]
                for label, put_in, shown in variants(span.kind, text[span.start : span.end]):
                    changed = before + put_in + after
                    start = len(before) + put_in.index(shown)
                    for found in candidates(changed):
                        if found[1:] == (start, start + len(shown)):
                            yield found.kind, float(label and found.kind == span.kind), held, features(changed, found)

    yield from batches_of(rows(), schema)


def variants(kind: int, own: str) -> Iterator[tuple[bool, str, str]]:
    """(is an example, what to write, the part of it that is the span) in place of a base span."""
    draw = np.random.default_rng(zlib.crc32(own.encode()))
    digits = "".join(DIGITS.findall(own))

    def number(size: int) -> str:
        return "".join(map(str, draw.integers(0, 10, size)))

    def plain(label: bool, *texts: str):
        yield from ((label, text, text) for text in texts)

    if kind == 0:
        name, host = own.split("@")
        parts = host.split(".")
        yield from plain(
            True,
            f"{name} at {' dot '.join(parts)}",
            f"{name} [at] {' [dot] '.join(parts)}",
            f"{name}(at){host}",
            f"{name}[at]{'[dot]'.join(parts)}",
        )
        yield False, f"looked at {host}", f"looked at {host}"
        yield False, f"met at {parts[0]}.{parts[-1]}", f"met at {parts[0]}.{parts[-1]}"
    elif kind == 1:
        parts = own.split(".")
        yield from plain(True, "[.]".join(parts), "(dot)".join(parts), "[dot]".join(parts))
        wrong = [*parts[:3], str(draw.integers(256, 1000))]
        yield from plain(False, ".".join(wrong), "[.]".join(wrong))
        version = ".".join(map(str, draw.integers(0, 10, 4)))
        yield False, f"version {version}", version
    elif kind == 2:
        fours = [digits[at : at + 4] for at in range(0, len(digits), 4)]
        yield from plain(True, ".".join(fours), "/".join(fours))
        short = digits[:14] + next(one for one in "0123456789" if luhn(digits[:14] + one))
        yield from plain(True, f"{short[:4]} {short[4:10]} {short[10:]}", f"{short[:4]}-{short[4:10]}-{short[10:]}")
        wrong = digits[:-1] + str((int(digits[-1]) + int(draw.integers(1, 10))) % 10)
        fours = [wrong[at : at + 4] for at in range(0, len(wrong), 4)]
        yield from plain(False, wrong, " ".join(fours), "-".join(fours), ".".join(fours), "/".join(fours))
        yield from plain(False, number(13), number(14), number(15))
    else:
        area, middle, line = digits[-10:-7].rjust(3, "0"), digits[-7:-4], digits[-4:]
        yield from plain(True, f"({area}) {middle}-{line}", f"{area}-{middle}-{line}", f"{area}.{middle}.{line}")
        for cue in ("tel. ", "phone: ", "call "):
            yield True, f"{cue}{area} {middle} {line}", f"{area} {middle} {line}"
            yield True, f"{cue}{middle}-{line}", f"{middle}-{line}"
        yield from plain(False, number(7), number(8), number(10), number(12), f"{number(4)}-{number(4)}")
        year, month, day = draw.integers(1900, 2100), draw.integers(1, 13), draw.integers(1, 29)
        yield from plain(
            False,
            f"{year}-{month:02}-{day:02}",
            f"{day:02}.{month:02}.{year}",
            f"{day:02}/{month:02}/{year}",
            f"{year}-{year + 5}",
            f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        )
        order = f"{number(3)}-{number(4)}"
        yield False, f"order {order}", order
