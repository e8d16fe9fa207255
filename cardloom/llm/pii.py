"""Personal data: patterns with checks, and a skip-chain conditional random field around them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed; label 0 is no personal data.
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPELT_AT = re.compile(r"[\[({]at[\])}]", re.IGNORECASE)
_SPELT_DOT = re.compile(r"\x20?[\[({]dot[\])}]\x20?", re.IGNORECASE)
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]++)++",
    re.IGNORECASE,
)
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_BEFORE = re.compile(r"[^\x20\x09-\x0D]*\Z")
_CORE = re.compile(r"[0-9A-Za-z+(@].*[0-9A-Za-z)]|[0-9A-Za-z]", re.DOTALL)

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an address starts where the run of local characters before its @ does."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", max(at + 1, floor))


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) << (i & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _is_ip(match: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in match.split("."))


def _digits(match: str) -> str:
    return "".join(c for c in match if c in "0123456789")


def _is_card(match: str) -> bool:
    return 12 <= len(digits := _digits(match)) <= 19 and _luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns that pass their checks, by start and then kind; time is linear in the text."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m.group())]
    spans += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and _is_card(m.group())]
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(spans)


@dataclass(frozen=True)
class CrfSettings:
    """``sample`` different rows, those with the smallest hashes among the rows with a candidate token, and the first
    ``tokens`` candidates of each bound what the weights are fitted on. Of the base spans in them the share ``hidden`` is
    written in a way that the patterns miss, and keeps its label.

    ``sure`` is the marginal that a token needs to become a span.
    """

    sample: int = 2000
    tokens: int = 500
    hidden: float = 0.2
    features: int = 4096
    steps: int = 200
    ridge: float = 1e-4
    sweeps: int = 8
    sure: float = 0.95


@dataclass
class Tokens:
    """Candidate tokens of one text: places, features, normal forms, and the label that base spans give (-1: none)."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    keys: list[tuple[str, ...]]
    numbers: list[int]
    given: list[int]

    def first(self, n: int) -> Tokens:
        return Tokens(self.spans[:n], self.features[:n], self.keys[:n], self.numbers[:n], self.given[:n])


def candidates(text: str, spans: list[Span], size: int) -> Tokens:
    """Tokens with a digit or an @, and addresses that are spelt out, as in ``name [at] host [dot] com``. All others are no
    personal data in this model, so they end a chain.

    A token within a base span has that span's label.
    """
    spelt = [m.span() for m in _SPELT.finditer(text)] if _SPELT_AT.search(text) else []
    next_spelt = 0
    out = Tokens([], [], [], [], [])
    number = last = next_span = 0
    by_end = sorted(spans, key=lambda s: s[0])
    at = 0
    previous = ""
    while True:
        mark = _MARK.search(text, at)
        while next_spelt < len(spelt) and spelt[next_spelt][0] < at:
            next_spelt += 1
        if next_spelt < len(spelt) and (not mark or spelt[next_spelt][0] <= mark.start()):
            start, end = spelt[next_spelt]
        elif mark:
            start = max(at, _start(text, mark.start(), at))
            space = _SPACE.search(text, mark.end())
            end = space.start() if space else len(text)
        else:
            return out
        gap = text[last:start]
        number += 1 if not gap.strip(" \t\n\r\x0b\x0c") else 2
        if gap.strip(" \t\n\r\x0b\x0c"):
            previous = gap[-40:].rsplit(None, 1)[-1] if gap[-40:].split() else ""
        token = text[start:end]
        while next_span < len(by_end) and by_end[next_span][2] <= start:
            next_span += 1
        label = -1
        for a, kind, b in by_end[next_span : next_span + 4]:
            if a < end and b > start:
                label = kind + 1
                break
        out.spans.append((start, end))
        out.features.append(_features(token, previous, text[end : end + 24].split(None, 1)[:1], size))
        out.keys.append(_keys(token))
        out.numbers.append(number)
        out.given.append(label)
        previous, last, at = token, end, end


def _start(text: str, mark: int, floor: int) -> int:
    """Start of the token around ``mark``, not before ``floor``."""
    return max(text.rfind(c, floor, mark) for c in " \t\n\r\x0b\x0c") + 1 if mark > floor else mark


def _plain(token: str) -> str:
    """An address that is spelt out in its usual form."""
    return _SPELT_DOT.sub(".", re.sub(rf"\x20?{_SPELT_AT.pattern}\x20?", "@", token, flags=re.IGNORECASE))


def _keys(token: str) -> tuple[str, ...]:
    """Tokens with a key in common are similar.

    Of a number with five or more digits the keys are its digits and, from seven on, the last seven, so that a number
    with and without its prefixes meets; of an address the address and, from four characters on, what is before its @.
    All other tokens have themselves in lower case.
    """
    word = (_plain(token) if _SPELT_AT.search(token) else token).lower().strip(".,;:!?|()\"'")
    if "@" in word:
        name = word.split("@", 1)[0]
        return (word, f"{name}@") if len(name) >= 4 else (word,)
    digits = _digits(token)
    if len(digits) >= 7:
        return digits, f"...{digits[-7:]}"
    return (digits,) if len(digits) >= 5 else (word,)


def _features(token: str, before: str, after: list[str], size: int) -> list[int]:
    short = token if len(token) <= 64 else token[:32] + token[-32:]
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", re.sub(r"[^\W\d_]+", "a", short))
    digits = _digits(short)
    core = short.strip(".,;:!?|()\"'")
    named = [
        "bias",
        f"shape {shape}",
        f"digits {min(len(digits), 20)}",
        f"at {'@' in token or bool(_SPELT.fullmatch(core))} dots {min(core.count('.'), 4)} plus {token[0] == '+'} letters {'a' in shape}",
        f"address {_is_address(core)} card {12 <= len(digits) <= 19 and _luhn(digits)} ip {_is_quad(core)}",
        f"before {before[-24:].lower()}",
        f"after {after[0].lower() if after else ''}",
    ]
    return [zlib.crc32(name.encode()) % size for name in named]


def _is_address(core: str) -> bool:
    name, at, domain = (_plain(core) if _SPELT_AT.search(core) else core).partition("@")
    return bool(at and name and _LOCAL.issuperset(name) and _DOMAIN.fullmatch(domain))


def _is_quad(core: str) -> bool:
    """Whether this is an address of four parts, also with its points in brackets."""
    quad = core.replace("[.]", ".").replace("(.)", ".")
    return bool(_IP.fullmatch(quad)) and _is_ip(quad)


def disguised(text: str, spans: list[Span], share: float) -> tuple[str, list[Span], list[Span]]:
    """The text with about a ``share`` of its spans written in a way that the patterns miss: the text, the places of all
    spans in it, and those of the changed ones. Whether a span is changed hangs on its text and place alone; spans that
    overlap others stay."""
    pieces, places, changed, at, grown = [], [], [], 0, 0
    for i, (start, kind, end) in enumerate(spans):
        alone = start >= at and (i + 1 == len(spans) or spans[i + 1][0] >= end)
        own = text[start:end]
        new = own
        if alone and zlib.crc32(f"{start}:{own}".encode()) < share * 2**32:
            new = _disguise(own, kind, zlib.crc32(own.encode()) % 2)
            pieces += [text[at:start], new]
            at = end
        place = (start + grown, kind, start + grown + len(new))
        places.append(place)
        if new != own:
            changed.append(place)
        grown += len(new) - len(own)
    return "".join(pieces) + text[at:], places, changed


def _disguise(own: str, kind: int, way: int) -> str:
    if kind == 0:
        at, dot = (" [at] ", " [dot] ") if way else ("(at)", "(dot)")
        name, _, domain = own.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == 1:
        return own.replace(".", "[.]" if way else "(.)")
    if kind == 2:
        digits = _digits(own)
        return ("." if way else "/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return own[1:]


def _edges(tokens: list[Tokens]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbouring tokens, and skip edges from each token to the next similar one of its text.

    Two tokens that a chain edge joins get no skip edge besides.
    """
    chain, skip, at = [], [], 0
    for one in tokens:
        latest: dict[str, int] = {}
        for i, keys in enumerate(one.keys):
            joined = i > 0 and one.numbers[i] == one.numbers[i - 1] + 1
            if joined:
                chain.append((at + i - 1, at + i))
            similar = {latest[key] for key in keys if key in latest}
            skip += [(at + j, at + i) for j in sorted(similar) if not (joined and j == i - 1)]
            latest |= dict.fromkeys(keys, i)
        at += len(one.keys)
    return (np.array(x, dtype=np.int64).reshape(-1, 2) for x in (chain, skip))


@dataclass(frozen=True)
class Crf:
    """Log potentials: of features by label, of neighbouring labels, and of the labels of similar tokens."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, tokens: list[Tokens], sweeps: int) -> np.ndarray:
        """Beliefs after ``sweeps`` of loopy sum-product message passing over all texts at once."""
        features = np.array([f for one in tokens for f in one.features], dtype=np.int64)
        given = np.array([g for one in tokens for g in one.given], dtype=np.int64)
        own = self.unary[features].sum(axis=1)
        known = given >= 0
        own[known] = -50.0
        own[known, given[known]] = 0.0
        chain, skip = _edges(tokens)
        source = np.concatenate((chain, chain[:, ::-1], skip, skip[:, ::-1]))
        tables = np.concatenate(
            [
                np.broadcast_to(t, (len(e), LABELS, LABELS))
                for t, e in ((self.chain, chain), (self.chain.T, chain), (self.skip, skip), (self.skip.T, skip))
            ]
        )
        a, b = len(chain), len(skip)
        back = np.concatenate((np.arange(a) + a, np.arange(a), np.arange(b) + 2 * a + b, np.arange(b) + 2 * a))
        messages = np.zeros((len(source), LABELS))
        for _ in range(sweeps if len(source) else 0):
            total = own.copy()
            np.add.at(total, source[:, 1], messages)
            out = total[source[:, 0]] - messages[back]
            raised = out[:, :, None] + tables
            top = raised.max(axis=1)
            new = top + np.log(np.exp(raised - top[:, None, :]).sum(axis=1))
            messages = 0.5 * messages + 0.5 * (new - new.max(axis=1, keepdims=True))
        np.add.at(own, source[:, 1], messages)
        own = np.exp(own - own.max(axis=1, keepdims=True))
        return own / own.sum(axis=1, keepdims=True)


def fit(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, settings: CrfSettings) -> Crf:
    """Piecewise training: the unary weights by regularised logistic regression, the edges by the labels they join.

    An edge's potential is the log ratio of how often two labels meet on it and how often they would by chance.
    """
    unary = np.zeros((settings.features, LABELS))
    if not len(labels):
        unary[:, 0] = 1.0
        return Crf(unary, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    scale = np.full_like(unary, 1e-8)
    target = np.eye(LABELS)[labels]
    for _ in range(settings.steps):
        scores = unary[features].sum(axis=1)
        shares = np.exp(scores - scores.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        slope = settings.ridge * unary
        np.add.at(slope, features.ravel(), np.repeat((shares - target) / len(labels), features.shape[1], axis=0))
        scale += slope**2
        unary -= 0.5 * slope / np.sqrt(scale)
    free = np.bincount(labels, minlength=LABELS) + 1.0
    free /= free.sum()

    def ratio(counts: np.ndarray) -> np.ndarray:
        joint = counts + counts.sum() * np.outer(free, free) * 0.1 + np.outer(free, free)
        return np.log(joint / joint.sum() / np.outer(free, free))

    return Crf(unary, ratio(chain), ratio((skip + skip.T) / 2))


def _weak_labels(settings: CrfSettings) -> Callable:
    """Counts for training, per document: features and label of each token, and the label pairs on its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"features": [], "labels": [], "chain": [], "skip": []}
            for text in batch.column("text").to_pylist():
                seen, places, _ = disguised(text, base_spans(text), settings.hidden)
                tokens = candidates(seen, sorted(places), settings.features).first(settings.tokens)
                labels = np.maximum(0, np.array(tokens.given, dtype=np.int64))
                rows["features"].append([f for token in tokens.features for f in token])
                rows["labels"].append(labels.tolist())
                for name, edges in zip(("chain", "skip"), _edges([tokens]), strict=True):
                    codes = labels[edges[:, 0]] * LABELS + labels[edges[:, 1]]
                    rows[name].append(np.bincount(codes, minlength=LABELS**2).tolist())
            arrays = {k: pa.array(v, pa.list_(pa.int64())) for k, v in rows.items()}
            keys = {name: batch.column(name) for name in ("doc_id", "part")}
            yield pa.RecordBatch.from_pydict(keys | arrays)

    return run


def trained(docs: DataFrame, settings: CrfSettings) -> Crf:
    """Fit the field on at most ``sample`` different rows and ``tokens`` candidates of each; labels are those of the base spans.

    Rows are chosen by slim keys and repeated ones count once, so neither texts nor copies come together in a task.
    """
    marked = docs.where("doc_id is not null").where(F.col("text").rlike(r"[0-9@]|(?i)[\[({]at[\])}]"))
    keyed = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("part"))
    order = [F.xxhash64("doc_id", "part"), "doc_id", "part"]
    chosen = keyed.select("doc_id", "part").distinct().orderBy(*order).limit(settings.sample)
    texts = keyed.join(F.broadcast(chosen), ["doc_id", "part"])
    lists = ("features", "labels", "chain", "skip")
    schema = "doc_id long, part long, " + ", ".join(f"{name} array<long>" for name in lists)
    rows = texts.mapInArrow(_weak_labels(settings), schema).dropDuplicates(["doc_id", "part"]).orderBy(*order).collect()
    width = len(_features("0", "", [], settings.features))
    gather = lambda name: np.array([x for row in rows for x in row[name]], dtype=np.int64)
    table = lambda name: np.sum([row[name] for row in rows] or [[0] * LABELS**2], axis=0).reshape(LABELS, LABELS)
    return fit(gather("features").reshape(-1, width), gather("labels"), table("chain"), table("skip"), settings)


def added_spans(text: str, tokens: Tokens, beliefs: np.ndarray, sure: float) -> list[Span]:
    """Spans of neighbouring tokens that the field is sure about, where no base span is; outer punctuation is left out."""
    found: list[Span] = []
    last = -2
    for i, belief in enumerate(beliefs):
        label = int(belief.argmax())
        if tokens.given[i] >= 0 or not label or belief[label] < sure:
            continue
        start, end = tokens.spans[i]
        core = _CORE.search(text[start:end])
        if not core:
            continue
        start, end = start + core.start(), start + core.end()
        if found and last == i - 1 and found[-1][1] == label - 1 and tokens.numbers[i] == tokens.numbers[i - 1] + 1:
            found[-1] = (found[-1][0], label - 1, end)
        else:
            found.append((start, label - 1, end))
        last = i
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _report(crf: Crf, settings: CrfSettings) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield report(batch.slice(at, 500))

    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text or "" for text in batch.column("text").to_pylist()]
        bases = [base_spans(text) for text in texts]
        tokens = [candidates(text, base, settings.features) for text, base in zip(texts, bases, strict=True)]
        total = sum(len(one.keys) for one in tokens)
        beliefs = crf.marginals(tokens, settings.sweeps) if total else np.zeros((0, LABELS))
        rows, at = [], 0
        for text, base, one in zip(texts, bases, tokens, strict=True):
            more = added_spans(text, one, beliefs[at : at + len(one.keys)], settings.sure)
            at += len(one.keys)
            counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
        columns = {"doc_id": batch.column("doc_id").cast(pa.int64())}
        for i, kind in enumerate(KINDS):
            columns[f"n_{kind}"] = pa.array([row[i] for row in rows], pa.int64())
        columns["base_sha256"] = pa.array([row[-3] for row in rows], pa.string())
        columns["spans"] = pa.array([row[-2] for row in rows], pa.string())
        columns["n_added"] = pa.array([row[-1] for row in rows], pa.int64())
        return pa.RecordBatch.from_pydict(columns)

    return run


def personal_data(docs: DataFrame, settings: CrfSettings | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): base spans by kind, their hash, and all spans as text.

    Base spans are evidence. The field's other tokens take labels from their looks, from their neighbours, and over skip
    edges from similar tokens anywhere in the document; loopy messages bring them into line. Spans that the field is sure
    about are added where no base span is. What it is taught with holds base spans that are disguised, so it finds addresses
    that are spelt out, points in brackets, cards with other separators, and numbers without their plus. Places are code
    points, ends exclusive.

    Null and empty texts have no spans. Repeated rows are judged each for themselves; a null ``doc_id`` stays null and
    teaches nothing. Other columns are not read. With nothing to learn from nothing is added; an empty table gives none.
    """
    settings = settings or CrfSettings()
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )
    return docs.select("doc_id", "text").mapInArrow(_report(trained(docs, settings), settings), schema)
