"""Personal data by candidate gradient boosting.

Exact patterns give the base spans. Besides, loose generators propose overlapping candidates with high recall
(written-out addresses, numbers without a prefix or with other separators), boosted trees score them by
features of format and context, and calibrated thresholds select the spans that are added.

The trees are trained on candidates of a bounded sample of documents: base spans and rewritings of them in
other formats are positive, candidates that no base span touches and broken rewritings are negative.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
DOC_CANDIDATES = 20
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16
PRECISION = 0.95
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[+(]?[0-9][0-9\x20().\-/_]*[0-9]")
_AT = re.compile(r"(?<![\w.%+-])([A-Za-z0-9][\w.%+-]{0,63})( ?(?:@|\(at\)|\[at\]|\{at\}) ?| (?:at|AT) )"
                 r"([A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?| (?:dot|DOT) )[A-Za-z0-9-]{2,63}){1,4})")
_HINT = re.compile(r"[0-9@]|\(at\)|\[at\]|\{at\}| at | AT ")
_CUES = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("call", "phone", "tel", "tél", "telefon", "mobile", "fax", "teléfono", "fon"),
}

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the exact patterns: leftmost, without overlap in a kind, in time linear in the text."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start, domain = at, _DOMAIN.match(text, at + 1)
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and domain:
            last = domain.end()
            found.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                found.append((at, end, "ip"))
            at = end + 1
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*match.span(), "card"))
    for match in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in match.group()) <= 15:
            found.append((*match.span(), "phone"))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of every kind, a superset of the base spans' formats."""
    found = [(*m.span(), "email") for m in _AT.finditer(text)]
    for match in _NUMBERS.finditer(text):
        start, end = match.span()
        for piece in re.finditer(r"[+(]?[0-9](?:[\x20().\-/_]{0,3}[0-9])*", text[start:end]):
            a, b = start + piece.start(), start + piece.end()
            digits = sum(map(str.isdigit, piece.group()))
            if 14 <= digits <= 19:
                found.append((a, b, "card"))
            if 9 <= digits <= 15:
                found.append((a, b, "phone"))
            if 4 <= digits <= 12 and len(re.findall("[0-9]+", piece.group())) == 4:
                found.append((a, b, "ip"))
    return found


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context."""
    start, end, kind = span
    value, counts = text[start:end], Counter(text[start:end])
    digits = "".join(c for c in value if "0" <= c <= "9")
    groups = [len(g) for g in re.findall("[0-9]+", value)]
    parts = re.findall("[0-9]+", value)
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    words = [w.strip(".,:;()").lower() for w in before.split()[-2:]]
    sizes = len(value) or 1
    return [
        *(float(kind == k) for k in KINDS),
        len(value), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        float(value.startswith("+")), float("(" in value and ")" in value), value.count("-"), value.count("."),
        value.count(" "), value.count("/") + value.count("_"), float("@" in value),
        float(bool(re.search(r"\.|\(dot\)|\[dot\]|\{dot\}| dot | DOT ", value))),
        float(bool(re.search(r"\(at\)|\[at\]|\{at\}", value))), sum(map(str.isalpha, value)) / sizes,
        float(bool(digits) and luhn(digits)), float(bool(parts) and all(map(_octet, parts))),
        float(bool(digits) and digits[0] in "3456"), len(set(digits)),
        -sum(n / sizes * math.log2(n / sizes) for n in counts.values()),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in tuple("$€£#.")), float(after[:1] in tuple("%€/.")),
        float(any(w in _CUES[kind] for w in words)),
    ]


def _rewritten(value: str, kind: str) -> list[tuple[str, int]]:
    """The value in other formats, and broken (0), for training."""
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        dotted = domain.replace(".", " dot ")
        return [(f"{local} at {dotted}", 1), (f"{local}(at){domain}", 1), (f"{local} [at] {domain.replace('.', ' [dot] ')}", 1),
                (f"{local} @ {domain}", 1), (f"{local} at {domain.replace('.', '')}.{local[:3]} then", 0)]
    digits = "".join(c for c in value if c.isdigit())
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        broken = digits[:-1] + str((int(digits[-1]) + 3) % 10)
        return [(".".join(fours), 1), ("/".join(fours), 1), ("  ".join(fours), 1), (broken, 0), (".".join([*fours[:-1], broken[-4:]]), 0)]
    if kind == "phone":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [(f"({a}) {b}-{c}", 1), (f"{a}-{b}-{c}", 1), (f"{a}.{b}.{c}", 1), (f"001 {a} {b} {c}", 1), (f"{a}{b}{c}", 0), (f"{a} {b}{c}", 0),
                (f"20{a[:2]}-0{a[2]}-1{b[0]} {b[1:]}", 0), (f"1{a[:1]}/0{a[1]}/20{b[:2]} {c}", 0)]
    parts = value.split(".")
    return [("-".join(parts), 0), (" ".join(parts), 0), (".".join(parts[:3]) + ".999", 0), ("/".join(parts), 0)]


def training_rows(text: str) -> list[tuple[list[float], int]]:
    """Features and labels of a document's candidates, and of rewritings of its base spans in their place."""
    base = base_spans(text)
    rows = []
    for span in candidates(text)[:DOC_CANDIDATES]:
        same = any(span[0] < b and a < span[1] and span[2] == k for a, b, k in base)
        other = any(span[0] < b and a < span[1] for a, b, _ in base)
        if same or not other or span[2] not in ("card", "phone"):
            rows.append((features(text, span), int(same)))
    for start, end, kind in base[:DOC_CANDIDATES]:
        before, after = text[max(0, start - 40) : start], text[end : end + 20]
        for value, label in _rewritten(text[start:end], kind):
            changed = f"{before}{value}{after}"
            rows.append((features(changed, (len(before), len(before) + len(value), kind)), label))
    return rows


class BoostedTrees:
    """Gradient boosting of shallow trees on the logistic loss, with a calibrated threshold for each kind."""

    def __init__(self) -> None:
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale, self.shift = 1.0, 0.0
        self.thresholds = dict.fromkeys(KINDS, math.inf)

    def _leaf(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, _ = tree
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return node

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((tree[2][self._leaf(tree, x)] for tree in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        cuts = [np.unique(np.concatenate([c, [column.min()]])) for c, column in zip(cuts, x.T)]
        score = np.zeros(len(x))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p) + 1e-6
            nodes = 2 ** (DEPTH + 1) - 1
            feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
            rows = {0: np.arange(len(x))}
            for node in range(2**DEPTH - 1):
                own = rows.get(node, np.zeros(0, np.int64))
                feature[node], cut[node] = self._split(x[own], gradient[own], weight[own], cuts)
                right = x[own, feature[node]] > cut[node]
                rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
            for node in range(2**DEPTH - 1, nodes):
                own = rows.get(node, np.zeros(0, np.int64))
                value[node] = RATE * gradient[own].sum() / (weight[own].sum() + 1.0)
            self.trees.append((feature, cut, value))
            score += value[self._leaf(self.trees[-1], x)]

    @staticmethod
    def _split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, cuts: list) -> tuple[int, float]:
        best, found = 1e-9, (0, math.inf)
        g, h = gradient.sum(), weight.sum()
        for f, values in enumerate(cuts):
            place = np.searchsorted(values, x[:, f])  # a value at a cut stays left
            gl = np.cumsum(np.bincount(place, gradient, len(values) + 1))[:-1]
            hl = np.cumsum(np.bincount(place, weight, len(values) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], (f, float(values[i]))
        return found

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """A logistic fit of held-out scores; each kind's threshold is the lowest with PRECISION on them."""
        raw = self.raw(x)
        for _ in range(25):
            p = self.probability(x)
            w = p * (1 - p) + 1e-6
            step = np.linalg.solve(
                np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]]),
                np.array([((y - p) * raw).sum(), (y - p).sum()]),
            )
            self.scale, self.shift = float(np.clip(self.scale + step[0], 0.05, 20)), float(np.clip(self.shift + step[1], -20, 20))
        p = self.probability(x)
        for i, kind in enumerate(KINDS):
            own = x[:, i] > 0
            order = np.argsort(-p[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            enough = np.flatnonzero(right >= PRECISION)
            if len(enough):
                self.thresholds[kind] = max(0.5, float(p[own][order][enough[-1]]))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> BoostedTrees:
    """Trees from the candidates of at most about `sample_docs` documents, chosen by hash; at most DOC_CANDIDATES of
    each, and TRAIN_ROWS in all, train. Without any they add no span."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(6), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def rows(frames):
        for frame in frames:
            found = [(x, y, zlib.crc32(text.encode())) for text in frame["text"] if text and _HINT.search(text)
                     for x, y in training_rows(text)]
            yield pd.DataFrame(found, columns=["x", "y", "doc"])

    made = sample.select("text").mapInPandas(rows, "x array<double>, y int, doc long")
    kept = made.orderBy(F.xxhash64("x", "doc"), "y", "doc").limit(TRAIN_ROWS).toPandas()
    model = BoostedTrees()
    if kept["y"].nunique() == 2:
        x, y, held = np.stack(kept["x"]), kept["y"].to_numpy(float), kept["doc"].to_numpy() % 3 == 0
        if len(set(y[held])) == 2 and len(set(y[~held])) == 2:
            model.fit(x[~held], y[~held])
            model.calibrate(x[held], y[held])
    return model


class _Covered:
    """Stretches of a text in order, without overlap."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        before = bisect_left(self.starts, span[1]) - 1
        return before >= 0 and self.ends[before] > span[0]

    def add(self, span: Span) -> None:
        """Of a span that meets none."""
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[1])


def all_spans(text: str, base: list[Span], model: BoostedTrees) -> list[Span]:
    """Base spans, and candidates over their kind's threshold that overlap neither them nor better candidates."""
    if not model.trees:
        return base
    taken, covered = list(base), _Covered(base)
    able = [c for c in candidates(text) if not covered.meets(c)]
    if able:
        p = model.probability(np.array([features(text, c) for c in able]))
        for score, span in sorted(zip(p, able), key=lambda s: (-s[0], _order(s[1]))):
            if score >= model.thresholds[span[2]] and not covered.meets(span):
                taken.append(span)
                covered.add(span)
    return sorted(taken, key=_order)


def scan(text: str | None, model: BoostedTrees) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a whole text."""
    if not text or not _HINT.search(text):
        return [], []
    base = base_spans(text)
    return base, all_spans(text, base, model)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of `docs` (doc_id, text; more columns
    are ignored). A null text is empty and has no span. Repeated rows are scanned each. An empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))  # some kilobytes

    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, spans = scan(text, model.value)
            counts = Counter(kind for _, _, kind in base)
            rows.append((*(counts[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    udf = F.pandas_udf(found, f"{kinds}, base_sha256 string, spans string")
    return docs.select("doc_id", udf("text").alias("p")).select("doc_id", "p.*")


def redact(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """`docs` with every span of its texts replaced by its kind in brackets; n_chars, where there is one, follows.

    Null texts stay null, empty ones empty; repeated rows are redacted each; an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))

    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([_redacted(t, scan(t, model.value)[1]) for t in texts], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(cleaned, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _redacted(text: str | None, spans: list[Span]) -> str | None:
    parts, last = [], 0
    for start, end, kind in spans:
        if start < last:  # kinds may overlap: what is left of the later one goes with it
            last = max(last, end)
            continue
        parts += [text[last:start], f"[{kind}]"]
        last = end
    return "".join([*parts, text[last:]]) if spans else text
