"""PII by patterns and a skip-chain conditional random field.

Patterns give the base spans of each text. Around them works a linear-chain CRF over a text's candidate
tokens (those with a digit, an at sign or a bracketed ``at`` or ``dot``, and the neighbours of the latter; all
other tokens are O by the model's definition), with skip edges between tokens that repeat or are similar (same
letters and digits, or the same digits). Tokens in base spans are clamped to their kinds; loopy message passing
carries them along chains and skip edges, so a number that is a phone in one place is one wherever
it recurs. Tokens whose marginal for a kind reaches ``SURE`` become additional spans.

What the patterns miss is learned from what they find: in a bounded sample, base hits are rewritten as people
do to evade or by habit (other separators, spelt out at signs, no country sign), and keep their kind; near
misses (a wrong check digit, a part over 255) are O. Feature weights, chain potentials and skip potentials are
fitted together by pseudo-likelihood, each token given the labels beside it and at its skip neighbours.

The pass over the texts is narrow; skip edges link each token to the previous one of its key, and each free one
to the first clamped token of every kind that its key has, so that evidence doesn't fade from
mention to mention and the edges of a token that recurs stay in proportion to its mentions.

Defined cases: a null text is empty and has no spans; texts of any length are read whole; overlapping spans of
different kinds are all reported; ``redact`` merges overlapping spans under the kind that starts first; without
training tokens only the base spans are found; repeated rows get equal results; an empty table gives none;
extra columns are not read by ``judge`` and are kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digit runs match whole, so a lookbehind replaces the starts inside a run that must fail.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Punctuation and marks that may stand around a token.
EDGE = "()[]{}<>.,;:!?\"'#*$%&|"
#: A spelt out at sign or dot.
MARKER = re.compile(r"[\[({<](?:at|dot)[\])}>]", re.IGNORECASE)

#: Rows of the training sample, at most, and documents that they are taken from, at most about.
TRAIN_TOKENS, TRAIN_DOCS = 20_000, 20_000
FEATURES = 1 << 12
#: The marginal that makes a span, and the largest potentials of an edge.
SURE, MOST = 0.9, 6.0
#: Messages are passed until none moves by more; the rounds are bounded only because loops may oscillate.
SETTLED, MOST_ROUNDS = 1e-4, 2_000


def emails(text: str) -> list[tuple[int, int]]:
    """Found at sign by sign, which is linear even in a long run without one."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in LOCAL_CHARS:
            low -= 1
        m = DOMAIN.match(text, at + 1) if low < at else None
        if m:
            end = m.end()
            out.append((low, end))
        at = text.find("@", max(at + 1, end))
    return out


def small_parts(found: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in found.split(".")))


def luhn(digits: str) -> bool:
    twice = ("0", "2", "4", "6", "8", "1", "3", "5", "7", "9")
    return not sum(int(d) if i % 2 == 0 else int(twice[int(d)]) for i, d in enumerate(reversed(digits))) % 10


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m.group())] if "." in text else []
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def tokens_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, position among all tokens) of the candidate tokens, without edge punctuation."""
    spelt = MARKER.search(text)
    if not spelt and not DIGIT.search(text) and "@" not in text:
        return []
    beside = {p + d for p, m in enumerate(TOKEN.finditer(text)) if MARKER.fullmatch(m.group()) for d in (-1, 1)} if spelt else ()
    out = []
    for place, m in enumerate(TOKEN.finditer(text)):
        t = m.group()
        if "@" in t or DIGIT.search(t) or place in beside or (spelt and MARKER.search(t)):
            bare = "" if spelt and MARKER.fullmatch(t) else EDGE
            left = len(t) - len(t.lstrip(bare)) if bare else 0
            right = len(t.rstrip(bare)) if bare else len(t)
            if left < right:
                out.append((m.start() + left, m.start() + right, place))
    return out


def shape(token: str) -> str:
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 9)}", re.sub(r"[^\W\d_]+", "a", token))[:24]


def features(text: str, tokens: list[tuple[int, int, int]]) -> list[list[int]]:
    """Hashed features of each token: its shape, marks and check digit, and the shapes beside it."""
    shapes = [shape(text[a:b]) for a, b, _ in tokens]
    out = []
    for i, (a, b, place) in enumerate(tokens):
        t = text[a:b]
        before = shapes[i - 1] if i and tokens[i - 1][2] == place - 1 else "-"
        after = shapes[i + 1] if i + 1 < len(tokens) and tokens[i + 1][2] == place + 1 else "-"
        digits = "".join(DIGITS.findall(t))
        n = len(digits)
        check = luhn(digits) if 14 <= n <= 19 else "-"
        names = (
            "bias", f"s={shapes[i]}", f"n={min(n, 20)}", f"l={text[a - 1 : a]}", f"p={before}", f"q={after}", f"m={'@' in t}{t.count('.')}{'-' in t}",
            f"ps={before}/{shapes[i]}", f"sq={shapes[i]}/{after}", f"a={any(map(str.isalpha, t))}", f"c={check}", f"k={MARKER.findall(t)[:1]}".lower(), f"o={n and max(map(int, DIGITS.findall(t))) > 255 if n < 14 else '-'}/{t.count('.')}",
        )
        out.append([crc32(x.encode("utf-8", "replace")) % FEATURES for x in names])
    return out


def base_labels(tokens: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The kind of the first base span that a token overlaps, else O. Both are in order, so this is one sweep."""
    out, open_spans, k = [], [], 0
    for a, b, _ in tokens:
        while k < len(spans) and spans[k][0] < b:
            open_spans.append(spans[k])
            k += 1
        open_spans = [s for s in open_spans if s[2] > a]
        out.append(1 + min(open_spans)[1] if open_spans else 0)
    return out


def rewritten(kind: int, found: str, rng: Random) -> str:
    """A base hit as it may be written where the pattern misses it."""
    if KINDS[kind] == "email":
        local, domain = found.split("@", 1)
        at, dot = rng.choice(("at", "AT")), rng.choice(("dot", "DOT"))
        a, b = rng.choice(("[]", "()", "{}", "<>"))
        return rng.choice((f"{local} @ {domain}", f"{local}{a}{at}{b}{domain}", f"{local} {a}{at}{b} {domain}", f"{local} {a}{at}{b} " + domain.replace(".", f" {a}{dot}{b} "), f"{local}{a}{at}{b}" + domain.replace(".", f"{a}{dot}{b}")))
    if KINDS[kind] == "ip":
        return found.replace(".", rng.choice(("[.]", "(.)", "{.}", ". ")))
    digits = "".join(DIGITS.findall(found))
    if KINDS[kind] == "card":
        return rng.choice((".", "/", "_", "  ", "--")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    land, area, rest = digits[:-10], digits[-10:-7], f"{digits[-7:-4]}{{}}{digits[-4:]}"
    mark = rng.choice("#*$%&|") * rng.randint(1, 3)
    return rng.choice((
        f"({area}) {rest.format('-')}", f"{land}-{area}-{rest.format('-')}".lstrip("-"), f"{area}.{rest.format('.')}", f"00{land} {area} {rest.format(' ')}", f"{land} ({area}) {rest.format('-')}".strip(),
        f"+{land}{mark} ({area}){mark} {rest.format('-')}", f"{digits}", f"{area}/{rest.format('')}",
    ))


def near_miss(kind: int, found: str, rng: Random) -> str:
    """What looks like a base hit and is none."""
    if KINDS[kind] == "email":
        return rng.choice((found.split("@")[0], f"@{found.split('@')[0]}", found.replace("@", "").replace(".", "")))
    if KINDS[kind] == "ip":
        parts = found.split(".")
        return rng.choice((".".join(parts[:3]), ".".join(parts[:2]), ".".join([*parts[:3], str(rng.randint(256, 999))]), ".".join([*parts, "1"])))
    digits = "".join(DIGITS.findall(found))
    if KINDS[kind] == "card":
        at = rng.randrange(len(digits))
        return digits[:at] + str((int(digits[at]) + rng.randint(1, 9)) % 10) + digits[at + 1 :]
    return rng.choice((digits[-4:], f"{digits[-7:-4]}.{digits[-4:-2]}", digits[-6:], f"{digits[-4:-2]}-{digits[-2:]}"))


def changed(text: str, spans: list[tuple[int, int, int]], how: Callable[[int, str, Random], str], rng: Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with each base span rewritten, and where they are then; spans that overlap an earlier one stay."""
    parts, out, end, size = [], [], 0, 0
    for a, k, b in spans:
        if a < end:
            continue
        new = how(k, text[a:b], rng)
        parts += [text[end:a], new]
        size += a - end
        out.append((size, k, size + len(new)))
        size += len(new)
        end = b
    return "".join([*parts, text[end:]]), out


def side_by_side(hits: list[tuple[int, str]], rng: Random) -> tuple[str, list[tuple[int, int, int]]]:
    """Hits with only a blank between them and made-up ones, where patterns run on into the next."""
    land, *more = (str(rng.randint(1, 9)), *(f"{rng.randrange(10**n):0{n}}" for n in (3, 3, 4)))
    every = [*hits, (KINDS.index("ip"), ".".join(str(rng.randint(0, 255)) for _ in range(4))), (KINDS.index("phone"), "+{} ({}) {}-{}".format(land, *more))]
    rng.shuffle(every)
    parts, spans, size = [], [], 0
    for k, x in every:
        spans.append((size, k, size + len(x)))
        parts.append(x)
        size += len(x) + 1
    return " ".join(parts), spans


def examples(text: str, rng: Random) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their true spans: the text itself; with hits rewritten; with near misses; with rewritten hits that recur after the text; and hits side by side."""
    spans = base_spans(text)
    yield text, spans
    if not spans:
        return
    yield changed(text, spans, rewritten, rng)
    missed, _ = changed(text, spans, near_miss, rng)
    yield missed, base_spans(missed)
    again, more = changed(text, spans, rewritten, rng)
    shift = len(text) + 1
    yield f"{text}\n{again}", spans + [(a + shift, k, b + shift) for a, k, b in more]
    yield side_by_side([(k, text[a:b]) for a, k, b in spans], rng)


@dataclass(frozen=True)
class Model:
    """Feature weights by label, potentials of labels side by side, and of equal labels along a skip edge."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit(features_of: np.ndarray, labels: np.ndarray, before: np.ndarray, after: np.ndarray, skips: np.ndarray, rounds: int = 300) -> Model:
    """Pseudo-likelihood: each label given its features, the labels beside it (-1: none) and those at its skip neighbours (counts by label)."""
    n, k = len(labels), len(LABELS)
    weights, chain, skip = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full(x.shape, 1e-6) for x in (weights, chain, skip)]
    goal = np.eye(k)[labels]
    flat = features_of.ravel()
    has_before, has_after = np.flatnonzero(before >= 0), np.flatnonzero(after >= 0)
    skips = np.minimum(skips, 3.0)
    for _ in range(rounds):
        z = weights[features_of].sum(1) + skips * skip
        z[has_before] += chain[before[has_before]]
        z[has_after] += chain.T[after[has_after]]
        p = np.exp(z - z.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - goal) / n
        spread = np.repeat(off, features_of.shape[1], axis=0)
        by_feature = np.column_stack([np.bincount(flat, weights=spread[:, y], minlength=FEATURES) for y in range(k)]) + 1e-4 * weights / n
        by_chain = np.zeros((k, k))
        np.add.at(by_chain, before[has_before], off[has_before])
        np.add.at(by_chain.T, after[has_after], off[has_after])
        for own, square, grad in zip((weights, chain, skip), squares, (by_feature, by_chain, (skips * off).sum(0))):
            square += grad * grad
            own -= 0.5 * grad / np.sqrt(square)
        np.clip(chain, -MOST, MOST, out=chain)
        np.clip(skip, 0.0, MOST, out=skip)
    return Model(weights, chain, skip)


def train(docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> Model | None:
    """A model from at most ``TRAIN_TOKENS`` tokens of documents chosen by a hash of the key."""
    share = min(1.0, TRAIN_DOCS / max(1, docs.count()))
    chosen = docs.filter(F.coalesce(F.pmod(F.xxhash64(F.col(key), F.lit("pii")), F.lit(1 << 30)), F.lit(0)) < int(share * (1 << 30)) + 1)
    chosen = chosen.select(F.coalesce(F.xxhash64(key), F.lit(0)).alias("place"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for own, spans in examples(text, Random(place)):
                    tokens = tokens_of(own)
                    true = base_labels(tokens, spans)
                    skips = [[0.0] * len(LABELS) for _ in tokens]
                    for a, b, is_skip in edges_of(own, tokens, base_labels(tokens, base_spans(own))):
                        if is_skip:
                            skips[a][true[b]] += 1
                            skips[b][true[a]] += 1
                    for i, f in enumerate(features(own, tokens)):
                        before = true[i - 1] if i and tokens[i - 1][2] == tokens[i][2] - 1 else -1
                        after = true[i + 1] if i + 1 < len(tokens) and tokens[i + 1][2] == tokens[i][2] + 1 else -1
                        rows.append((place, at, f, true[i], before, after, skips[i]))
                        at += 1
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["place", "at", "features", "label", "before", "after", "skips"])

    schema = "place long, at int, features array<int>, label int, before int, after int, skips array<double>"
    rows = chosen.mapInArrow(run, schema).orderBy("place", "at").limit(TRAIN_TOKENS).toPandas()
    if not len(rows):
        return None
    return fit(np.array(rows["features"].tolist()), *[rows[c].to_numpy() for c in ("label", "before", "after")], np.array(rows["skips"].tolist()))


def marginals(unary: np.ndarray, clamped: np.ndarray, a: np.ndarray, b: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Loopy sum-product over all unsettled edges at once; ``pair`` has an edge's log potentials. Clamped labels are -1 where free."""
    node = unary.copy()
    fixed = clamped >= 0
    node[fixed] = -50.0
    node[fixed, clamped[fixed]] = 0.0
    forth, back = np.zeros((len(a), node.shape[1])), np.zeros((len(a), node.shape[1]))
    belief, live = node.copy(), np.arange(len(a))

    def log_sum(x: np.ndarray) -> np.ndarray:
        high = x.max(1, keepdims=True)
        out = (high + np.log(np.exp(x - high).sum(1, keepdims=True)))[:, 0]
        return out - out.max(1, keepdims=True)

    for _ in range(MOST_ROUNDS):
        if not len(live):
            break
        s, t, own = a[live], b[live], pair[live]
        more_forth = 0.5 * (log_sum((belief[s] - back[live])[:, :, None] + own) - forth[live])
        more_back = 0.5 * (log_sum((belief[t] - forth[live])[:, :, None] + own.transpose(0, 2, 1)) - back[live])
        more_forth[fixed[t]] = more_back[fixed[s]] = 0.0  # a clamped label stays, however many tokens are linked to it
        forth[live] += more_forth
        back[live] += more_back
        np.add.at(belief, t, more_forth)
        np.add.at(belief, s, more_back)
        touched = np.zeros(len(node), bool)
        touched[t[np.abs(more_forth).max(1) > SETTLED]] = True
        touched[s[np.abs(more_back).max(1) > SETTLED]] = True
        live = np.flatnonzero(touched[a] | touched[b])
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def skip_keys(token: str) -> list[str]:
    """What makes tokens repeated or similar: the same letters and digits, or the same six or more digits."""
    plain = "".join(filter(str.isalnum, token)).lower()
    digits = "".join(filter(str.isdigit, token))
    return [plain] + ([f"#{digits}"] if len(digits) >= 6 and digits != plain else [])


def edges_of(text: str, tokens: list[tuple[int, int, int]], labels: list[int]) -> list[tuple[int, int, bool]]:
    """(earlier token, later token, whether it is a skip edge); ``labels`` are those of the base spans."""
    keys = [skip_keys(text[s:e]) for s, e, _ in tokens]
    marked: dict[str, dict[int, int]] = {}
    for i, y in enumerate(labels):
        for key in keys[i] if y else ():
            marked.setdefault(key, {}).setdefault(y, i)
    out, last = [], {}
    for i, (_, _, place) in enumerate(tokens):
        if i and tokens[i - 1][2] == place - 1:
            out.append((i - 1, i, False))
        linked = [last[key] for key in keys[i] if key in last]
        if not labels[i]:
            linked += {m for key in keys[i] for m in marked.get(key, {}).values()}.difference(linked)
        out += [(m, i, True) for m in linked]
        last.update((key, i) for key in keys[i])
    return out


def spans_of(texts: list[str | None], model: Model | None) -> list[tuple[list, list]]:
    """Base spans and all spans of each text; one message passing over the texts' separate graphs."""
    base = [base_spans(t) for t in texts]
    own = [tokens_of(t) if t and model else [] for t in texts]
    known = [base_labels(tokens, spans) for tokens, spans in zip(own, base)]
    rows, clamps, edges, starts = [], [], [], []
    for text, tokens, labels in zip(texts, own, known):
        n = len(rows)
        starts.append(n)
        if all(labels):  # nothing is left to decide
            continue
        rows += features(text, tokens)
        clamps += [x or -1 for x in labels]
        edges += [(n + a, n + b, is_skip) for a, b, is_skip in edges_of(text, tokens, labels)]
    out = [(spans, spans) for spans in base]
    if not rows:
        return out
    unary = model.weights[np.array(rows)].sum(1)
    a, b, skip = (np.array(x) for x in zip(*edges)) if edges else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
    pair = np.where(skip[:, None, None], np.diag(model.skip)[None], model.chain[None]) if len(skip) else np.zeros((0, len(LABELS), len(LABELS)))
    found = marginals(unary, np.array(clamps), a, b, pair)
    label, sure = found.argmax(1), found.max(1) >= SURE
    for k, (spans, tokens, labels) in enumerate(zip(base, own, known)):
        if all(labels):
            continue
        more: list[tuple[int, int, int]] = []
        joined = -2
        for i, (s, e, place) in enumerate(tokens):
            y = int(label[starts[k] + i])
            if labels[i] or not y or not sure[starts[k] + i]:
                continue
            if more and joined == i - 1 and more[-1][1] == y - 1 and tokens[i - 1][2] == place - 1:
                more[-1] = (more[-1][0], y - 1, e)
            else:
                more.append((s, y - 1, e))
            joined = i
        if more:
            out[k] = (spans, sorted({*spans, *more}))
    return out


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def judge(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone of the base, base_sha256, spans) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, key))

    def make():
        def work(texts):
            rows = []
            for base, every in spans_of(texts, shared.value):
                kinds = [k for _, k, _ in base]
                rows.append((*[kinds.count(i) for i in range(len(KINDS))], hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(every)))
            return [list(x) for x in zip(*rows)]

        return work

    fields = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType())]
    out = C.map_texts(docs, text_col, fields, make, carry=[key])
    return out.select(*C.unpack(out, key), *[n for n, _ in fields])


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, end = [], 0
    for a, k, b in spans:
        if a >= end:
            parts += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def redact(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns; every span of the text becomes the kind's name in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, key))

    def make():
        return lambda texts: [[masked(t, every) if every else t for t, (_, every) in zip(texts, spans_of(texts, shared.value))]]

    out = C.map_texts(docs, text_col, [("_masked", T.StringType())], make)
    return out.select(*[F.col("_masked").alias(c) if c == text_col else F.col(f"{C.CARRIED}.`{c}`").alias(c) for c in docs.columns])
