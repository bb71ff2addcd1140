"""Personal data: patterns for four kinds, and spans that a character-level model adds.

Base spans come from patterns (see base_spans), over whole texts, in time linear in the text. The model, a bidirectional LSTM
with CRF transitions, finds forms that the patterns miss (numbers without a plus, cards with other separators, addresses
spelled with spaces, brackets or words). It is trained here, in numpy, on labelled spans: base spans of a bounded sample of
texts, and the same spans respelled in place.

A text is cut into overlapping windows; scores at a character are averaged over all windows that hold it, weighed by the
distance to the window's edge, and each stretch is decoded once, as a whole. A span of the model needs a sign: a digit, an @, or
a word that stands for one. So only stretches around signs are decoded, and only windows that reach into them are scored, all of
them: scores there are those of scoring every window (a test holds both against each other, decoding whole texts too).

The model only adds: base spans stay, and a model span that touches a base span or fails its kind's checks is dropped.

Defined results: a null or empty text has no spans, and the hash of the empty string; null doc_ids are kept; repeated rows
give equal results; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.bilstm_crf import BiLstmCrf
from loomspan.llm.common import small_batches
from loomspan.sources.tables import table

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
#: The bound of the training sample: texts of each kind, and of other texts with signs, the longest of them, and windows made from them.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_WINDOWS = 100, 20_000, 1600
#: The least mean margin, over a span, of its tags' scores over those of no span.
MARGIN = 2.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]|[\[({]\s*[aA][tT]\s*[\])}]|\b[dD][oO][tT]\b")
#: What texts that may hold a kind look like, to Spark.
_LIKE = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9]([\x20-]?[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]{7}"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the patterns' spans, by start, then by kind as listed."""
    found = []
    if "@" in text:
        end = 0
        for m in re.finditer("@", text):
            at = m.start()
            if at < end:
                continue
            a = at
            while a > end and _LOCAL.match(text[a - 1]):
                a -= 1
            if a < at and (d := _DOMAIN.match(text, at + 1)):
                end = d.end()
                found.append((a, end, "email"))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# Symbols: 0 fills windows; letters without case, one for all digits, other ASCII, then all letters, spaces and marks beyond.
_FILL, _DIGIT, _LETTER, _SPACE, _OTHER = 0, 27, 28, 29, 30
_ASCII = np.full(128, _OTHER, np.int16)
for _c in range(128):
    _ch = chr(_c)
    _ASCII[_c] = ord(_ch.lower()) - 96 if _ch.isalpha() else _DIGIT if _ch.isdigit() else _SPACE if _ch.isspace() else 31 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".find(_ch) if _ch in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else _OTHER
SYMBOLS, TAGS = 31 + 32, 1 + 2 * len(KINDS)
#: Tags: 0 for none, then for each kind one for its first character and one for the others, which only follows these two.
_NEVER = np.array([[t and t % 2 == 0 and f not in (t - 1, t) for t in range(TAGS)] for f in range(TAGS + 1)], bool)


def symbols(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, _ASCII[np.minimum(x, 127)], _LETTER)


def windows(text: str) -> tuple[list[int], int]:
    """The numbers of the windows that hold a sign, and of the last window. A window starts at its number times STRIDE."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    own: set[int] = set()
    for m in _SIGN.finditer(text):
        for k in range(max(0, m.start() // STRIDE - 1), min(last, (m.end() - 1) // STRIDE) + 1):
            own.add(k)
    return sorted(own), last


def _respelled(kind: str, text: str, r: random.Random) -> str:
    """A form of the same datum that the patterns don't take."""
    if kind == "email":
        at, dot = r.choice([(" @ ", "."), ("@", " . "), (" @ ", " . "), ("(@)", "."), ("[@]", "[.]"), ("@", "[.]"), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", ".")])
        return text.replace("@", at).replace(".", dot)
    if kind == "ip":
        return text.replace(".", r.choice(["[.]", " . ", "(.)"]))
    d = _digits(text)
    if kind == "card":
        return r.choice([".", "_", "/", " - "]).join(d[k:k + 4] for k in range(0, len(d), 4))
    d = d[-10:]
    return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00 {} {} {}"]).format(d[:3], d[3:6], d[6:])


def _varied(kind: str, text: str, r: random.Random) -> str:
    """Another datum of the kind: for an address, other letters and a name of other length."""
    if kind != "email":
        return text
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a, z: "".join(r.choice(letters) for _ in range(r.randint(a, z)))
    return r.choice([word(2, 8), f"{word(2, 6)}.{word(2, 8)}", f"{word(2, 6)}{r.randint(1, 99)}"]) + "@" + ".".join(word(2, 8) for _ in range(r.randint(1, 2))) + "." + r.choice(["com", "org", "net", "de", "fr"])


def labelled(texts: list[str], most: int = SAMPLE_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from texts: around base spans, as they are and respelled, and around other digits and marks."""
    r = random.Random(seed)
    found = [(t, s) for t in texts for s in base_spans(t)]
    r.shuffle(found)
    x, y = [], []

    def add(text: str, spans: list[tuple[int, int, str]], near: int) -> None:
        a = max(0, near - r.randrange(8, WINDOW - 8))
        sym, tag = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        own = symbols(text[a:a + WINDOW])
        sym[:len(own)] = own
        for s, e, kind in spans:
            k = 1 + 2 * KINDS.index(kind)
            for p in range(max(s, a), min(e, a + WINDOW)):
                tag[p - a] = k + (p > s)
        x.append(sym)
        y.append(tag)

    for kind in KINDS:
        own = [f for f in found if f[1][2] == kind]
        for n in range(most // 6 if own else 0):
            t, (s, e, _) = own[n % len(own)]
            if n % 3 == 0:
                add(t, base_spans(t), r.randrange(s, e))
            else:
                new = _respelled(kind, _varied(kind, t[s:e], r), r)
                lead, tail = t[max(0, s - r.randint(0, 80)):s], t[e:e + r.randint(0, 80)]
                add(lead + new + tail, [(len(lead), len(lead) + len(new), kind)], len(lead) + r.randrange(len(new)))
    free = [(t, m.start()) for t in texts for spans in [base_spans(t)] for m in _SIGN.finditer(t) if not any(s <= m.start() < e for s, e, _ in spans)]
    for t, p in r.sample(free, min(len(free), most // 3)) if x else []:
        add(t, base_spans(t), p)
    return np.array(x).reshape(-1, WINDOW), np.array(y).reshape(-1, WINDOW)


def train(texts: list[str], seed: int = 5) -> BiLstmCrf | None:
    """A model from the labelled spans of texts; None where there are none. A kind that no text holds isn't learned: that is warned of."""
    x, y = labelled(texts, seed=seed)
    kinds = {KINDS[(t - 1) // 2] for t in np.unique(y) if t} if len(x) else set()
    if missing := [k for k in KINDS if k not in kinds]:
        warnings.warn(f"no text of the sample holds {', '.join(missing)}: the model can't find these kinds", stacklevel=2)
    if not kinds:
        return None
    model = BiLstmCrf(SYMBOLS, TAGS, seed=seed, never=_NEVER)
    model.train(x, y, seed=seed)
    return model


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _plausible(kind: str, text: str) -> bool:
    n = len(_digits(text))
    if kind == "email":
        spelled = re.search(r"(?i)\bat\b", text) and re.search(r"(?i)\bdot\b|\.", text)
        return len(text) >= 6 and bool("@" in text or spelled) and len(text.split()) <= 9
    if kind == "ip":
        return 4 <= n <= 12 and len(parts := re.findall("[0-9]+", text)) == 4 and all(int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= n <= 19 and luhn(_digits(text)) and not re.search("[A-Za-z]", text)
    return 9 <= n <= 15 and not re.search("[A-Za-z]", text) and len(re.findall(r"[^0-9]+", text)) >= 2


def model_spans(model: BiLstmCrf, texts: list[str], whole: bool = False) -> list[list[tuple[int, int, str]]]:
    """The model's spans in each text. whole: score and decode all of every text, not only what lies around signs."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    stretches: list[tuple[int, int, int]] = []  # text, first and last window
    need: list[tuple[int, int]] = []
    for d, t in enumerate(texts):
        own, last = windows(t)
        if whole:
            own = list(range(last + 1)) if t else []
        for k in own:
            if stretches and stretches[-1][0] == d and stretches[-1][2] == k - 1:
                stretches[-1] = (d, stretches[-1][1], k)
            else:
                stretches.append((d, k, k))
        need += [(d, k) for k in sorted({j for k in own for j in (k - 1, k, k + 1) if 0 <= j <= last})]
    place = {x: n for n, x in enumerate(need)}
    done, scores = 0, []  # emissions of need[done:], no more than a stretch needs

    def emissions(n: int) -> np.ndarray:
        nonlocal done, scores
        while n >= done + len(scores):
            a = done + len(scores)
            own = need[a:a + 1024]
            x = np.zeros((len(own), WINDOW), np.int64)
            for j, (d, k) in enumerate(own):
                sym = symbols(texts[d][k * STRIDE:k * STRIDE + WINDOW])
                x[j, :len(sym)] = sym
            scores.extend(model.emissions(x))
        return scores[n - done]

    for d, k, z in stretches:
        first = k * STRIDE
        n = min(len(texts[d]), z * STRIDE + WINDOW) - first
        total, weight = np.zeros((n, TAGS), np.float32), np.zeros(n, np.float32)
        for j in range(k - 1, z + 2):
            if (d, j) in place:
                o = j * STRIDE - first
                a, e = max(0, o), min(n, o + WINDOW)
                if a < e:
                    own = emissions(place[d, j])[a - o:e - o]
                    total[a:e] += own * _WEIGHT[a - o:e - o, None]
                    weight[a:e] += _WEIGHT[a - o:e - o]
        joined = total / weight[:, None]
        out[d] += _read(model.decode(joined), joined, first, texts[d])
        if len(scores) > 4096:  # stretches come in order: what lies well before this one is done with
            drop = place[d, k] - done - 2
            if drop > 0:
                scores, done = scores[drop:], done + drop
    return out


def _read(tags: np.ndarray, scores: np.ndarray, first: int, text: str) -> list[tuple[int, int, str]]:
    found, k = [], 0
    while k < len(tags):
        if tags[k] == 0:
            k += 1
            continue
        kind, z = (int(tags[k]) - 1) // 2, k + 1
        while z < len(tags) and tags[z] == 2 + 2 * kind:
            z += 1
        margin = float(np.mean(scores[np.arange(k, z), tags[k:z]] - scores[k:z, 0]))
        s, e = first + k, first + z
        while s < e and text[s].isspace():
            s += 1
        while s < e and (text[e - 1].isspace() or text[e - 1] in ".,;:"):
            e -= 1
        if margin >= MARGIN and s < e and _SIGN.search(text[s:e]) and _plausible(KINDS[kind], text[s:e]):
            found.append((s, e, KINDS[kind]))
        k = z
    return found


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def sample(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_TEXTS) -> list[str]:
    """Distinct texts by hash: of each kind about `most` whose texts look like it, and as many others with digits. One pass counts
    the texts of each kind by a sketch, another takes its share of them; copies are one."""
    t = F.col(text_col).cast("string")
    h = F.xxhash64(F.lit(9), t)
    rows = docs.select(t.alias("t"), h.alias("h"), *(t.rlike(p).alias(k) for k, p in _LIKE.items())).where(F.length("t") <= SAMPLE_CHARS)
    rows = rows.withColumn("other", F.col("t").rlike("[0-9]") & ~F.greatest(*_LIKE))
    kinds = [*_LIKE, "other"]
    n = rows.agg(*(F.approx_count_distinct(F.when(F.col(k), F.col("h")), 0.02).alias(k) for k in kinds)).first()
    share = (F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53)))
    mine = [F.col(k) & (share < 1.5 * most / max(1, n[k])) for k in kinds]
    drawn = rows.where(F.greatest(*mine)).dropDuplicates(["h"]).select("h", "t", *kinds).collect()  # some 1.5 * most for each kind
    drawn.sort(key=lambda r: r["h"] & (1 << 64) - 1)
    picked: dict[int, str] = {}
    for k in kinds:
        picked |= {r["h"]: r["t"] for r in [r for r in drawn if r[k]][:most]}
    return [picked[k] for k in sorted(picked)]


def find(docs: DataFrame, model: BiLstmCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            signed = [k for k, t in enumerate(texts) if _SIGN.search(t)]
            base: list[list] = [[] for _ in texts]
            more: list[list] = [[] for _ in texts]
            for k in signed:
                base[k] = base_spans(texts[k])
            if own is not None:
                for k, spans in zip(signed, model_spans(own, [texts[k] for k in signed])):
                    more[k] = [s for s in spans if not any(s[0] < e and a < s[1] for a, e, _ in base[k])]
            counts = [pa.array([sum(s[2] == kind for s in x) for x in base], pa.int64()) for kind in KINDS]
            every = [_join(sorted(x + y, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))) for x, y in zip(base, more)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array([hashlib.sha256(_join(x).encode()).hexdigest() for x in base], pa.string()), pa.array(every, pa.string()), pa.array([len(x) for x in more], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_model"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long")


def op1_bilstm_crf_pii(spark: SparkSession, root: str) -> DataFrame:
    """Spans of personal data in documents, with a model trained on a sample of them."""
    docs = table(spark, root, "documents")
    return find(docs, train(sample(docs)))
