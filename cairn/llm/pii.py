"""Personal data: rules, and a linear-chain conditional random field over word shapes.

The rules find e-mail addresses, network addresses, card numbers and telephone numbers as they
are usually written.  The field labels every word of a text with one of these kinds or none, from
the shapes of the word and its two neighbours; it is fitted to a small table of labelled lines
and to windows of a bounded sample of documents in which the rules are the labels, and adds what
is written otherwise.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.blocks import tidied
from cairn.llm.bpe import parts

KINDS = ["email", "ip", "card", "phone"]
NONE, EMAIL, IP, CARD, PHONE = range(5)
LABELS = len(KINDS) + 1
#: Documents of which windows are taken for fitting, windows of them all, and words to either side of what a window shows.
SAMPLE, WINDOWS, SIDE = 20_000, 6000, 6
EPOCHS, BATCH = 6, 256
#: Words that are decoded as one step of the batch, text of a batch, and shapes that a task remembers.
SEGMENT, PART_BYTES, PART_DOCS, SHAPES = 64, 1 << 20, 1024, 1 << 16
#: Bytes of a word that its shape is made of.
SHAPE_BYTES = 64
#: Characters of the longest text that the field may add.
LONGEST = 80

#: Lines of made-up personal data, {kind:text}, and of numbers that are none.
LABELLED = """
write to {email:jo.doe [at] mail.example.com} today
contact {email:jane(at)example.org} or {email:max@example.net} for help
mail {email:ann_lee (at) post.example.com} please
my address is {email:b.k+x@sub.example.co} thanks
the host {ip:192.0.2.17} did not answer
blocked {ip:198.51.100[.]23} and {ip:203[.]0[.]113[.]9} at night
card {card:4111 1111 1111 1111} expires soon
paid with {card:5500.0000.0000.0004} in March
number {card:4012/8888/8888/1881} was declined
call {phone:+1 (212) 555-0100} now
call me at {phone:(212) 555-0123} before noon
my number is {phone:212-555-0147} today
phone {phone:212.555.0191} or fax {phone:(646) 555-0108} please
from abroad {phone:0044 20 7946 0958} works
ring {phone:1-800-555-0199} at any time
tel {phone:+44 20 7946 0321} office
version 1.2.3 was built on 2021-03-14 at 10:15
order 4465758382 of 12,500 pieces weighs 3.75 kg
see pages 12-14 and figure 3.1 of chapter 2
commit 9f86d081884c7d65 has 120 lines (34 new)
from 1998-2004 about 1,234,567 people (56 of 100)
id 550e8400-e29b-41d4-a716-446655440000 is free
section (212) of the act of 1934 has 5 parts
total 1 234 567.89 for 10 items at 99.95 each
she said (at) last that all was well
a ratio of 16:9 or 4:3 is usual on 1920x1080 screens
""".strip().splitlines()  # fmt: skip

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WRITTEN_OUT = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[({<] ?(?:at|AT) ?[\])}>]) ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A byte's class: letters small or large, digits, bytes of other characters as small letters; the rest stays.
CLASSES = bytes(100 if 48 <= b <= 57 else 88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else b for b in range(256))


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ back over the local part, as far as the last address allows, and on over the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def small(number: str) -> bool:
    """Whether a number of any length is 255 at most."""
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def is_card(text: str) -> bool:
    digits = re.sub(r"[^0-9]", "", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= sum(c.isdigit() for c in text) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the rules find, by kind and start; each kind takes linear time."""
    out = [(EMAIL, *span) for span in emails(text)]
    out += [(IP, *m.span()) for m in ADDRESS.finditer(text) if all(map(small, m[0].split(".")))]
    out += [(CARD, *m.span()) for m in DIGITS.finditer(text) if m.end() - m.start() >= 13 and is_card(m[0])]
    out += [(PHONE, *m.span()) for m in DIALLED.finditer(text) if is_phone(m[0])] if "+" in text else []
    return out


def shapes(text: bytes) -> list[bytes]:
    """The class of each byte of each word."""
    return text.translate(CLASSES).split()


def features(shape: bytes) -> list[str]:
    """What the field knows of a word: its shape with runs cut short, what is in it, and how it begins and ends."""
    if not shape:
        return ["edge"]
    shape = shape[:SHAPE_BYTES].decode("ascii", "replace")
    core = shape.strip(".,;:!?*&%$#\"'<>|`~^=_\\") or shape
    short = re.sub(r"d+", lambda m: f"d{min(len(m[0]), 5)}", re.sub(r"(?:x|X){3,}", "x", core))
    digits = shape.count("d")
    return [
        f"s:{short[:24]}",
        f"k:{re.sub(r'[xXd]+', lambda m: m[0][0], core)[:16]}",
        f"n:{digits if digits < 5 else 5 + min((digits - 5) // 4, 4)}",
        f"l:{min(len(core), 40).bit_length()}",
        f"b:{core[0]}",
        f"e:{core[-1]}",
        f"p:{core.count('.')}{core.count('-')}"[:5],
        f"m:{'@' in core}{'(x' in core or '[x' in core}{digits > 0}",
    ]


class Field:
    """A linear-chain conditional random field; the weights have a row for each feature, and one of zeros at the end.

    own, before and after are what a word's features say about itself, the next and the last word; a
    text begins as if a word without personal data stood before it.
    """

    def __init__(self, names: list[str], own: np.ndarray, before: np.ndarray, after: np.ndarray, move: np.ndarray):
        self.names, self.weights = names, [own, before, after, move]
        self.at = {n: i for i, n in enumerate(names)}
        self.number: dict[bytes, int] = {}
        self.held = np.empty((3, 0, LABELS), np.float32)

    @classmethod
    def fresh(cls, names: list[str]) -> Field:
        return cls(names, *(np.zeros((len(names) + 1, LABELS)) for _ in range(3)), np.zeros((LABELS, LABELS)))

    def listed(self, found: list[bytes]) -> np.ndarray:
        """Rows of the features of each shape; unknown ones have none."""
        rows = [[self.at.get(f, len(self.names)) for f in features(s)] for s in found]
        wide = max(map(len, rows), default=1)
        return np.array([r + [len(self.names)] * (wide - len(r)) for r in rows], np.int64).reshape(-1, wide)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """Numbers of shapes; what they say is worked out once for each."""
        if len(self.number) > SHAPES:
            self.number, self.held = {}, self.held[:, :0]
        new = [s for s in dict.fromkeys((b"", *found)) if s not in self.number]
        if new:
            listed = self.listed(new)
            more = np.stack([w[listed].sum(axis=1) for w in self.weights[:3]]).astype(np.float32)
            self.number.update(zip(new, range(self.held.shape[1], self.held.shape[1] + len(new)), strict=True))
            self.held = np.concatenate((self.held, more), axis=1)
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def decode(self, texts: list[list[bytes]]) -> np.ndarray:
        """The best labels of the words of each text, all in one array.

        Each text is cut into segments.  All of them are run through at once, for each label that
        may stand before; then the segments of a text are joined, and the labels read backwards.
        """
        sizes = np.array(list(map(len, texts)), np.int64)
        if not sizes.sum():
            return np.empty(0, np.uint8)
        edge = self.numbers([b""])[0]
        flat = self.numbers([s[:SHAPE_BYTES] for t in texts for s in t])
        edge = self.number[b""]
        begins = np.cumsum(sizes) - sizes
        last, after = np.concatenate(([edge], flat[:-1])), np.concatenate((flat[1:], [edge]))
        last[begins[sizes > 0]] = edge
        after[(begins + sizes - 1)[sizes > 0]] = edge
        said = self.held[0, flat] + self.held[1, last] + self.held[2, after]
        move = self.weights[3].astype(np.float32)
        # Segments: first word, words, text.
        count = -(-sizes // SEGMENT)
        of = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        first = begins[of] + nth * SEGMENT
        length = np.minimum(sizes[of] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        of, nth, first, length = of[order], nth[order], first[order], length[order]
        best = np.broadcast_to(np.where(np.eye(LABELS, dtype=bool), 0, -np.inf).astype(np.float32), (len(of), LABELS, LABELS)).copy()
        back = np.zeros((int(length[0]), len(of), LABELS, LABELS), np.uint8)
        active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for t, n in enumerate(active.tolist()):
            # Over the label before, of all that are now possible.
            top, who = best[:n, :, 0, None] + move[0], np.zeros((n, LABELS, LABELS), np.uint8)
            for j in range(1, LABELS):
                other = best[:n, :, j, None] + move[j]
                better = other > top
                top = np.where(better, other, top)
                who[better] = j
            back[t, :n] = who
            best[:n] = top + said[first[:n] + t][:, None]
        # Over the segments of each text, the label before each and the last one of all.
        inverse = np.empty(len(of), np.int64)
        inverse[order] = np.arange(len(of))
        enters = np.zeros(len(of), np.int64)
        ends = np.zeros(len(of), np.int64)
        at = 0
        for n in count.tolist():
            own = inverse[at : at + n]
            at += n
            score, froms = np.where(np.arange(LABELS) == NONE, 0, -np.inf), []
            for k in own.tolist():
                through = score[:, None] + best[k]
                froms.append(through.argmax(axis=0))
                score = through.max(axis=0)
            label = int(score.argmax()) if n else NONE
            for k, came in zip(own[::-1].tolist(), froms[::-1], strict=True):
                ends[k] = label
                label = int(came[label])
                enters[k] = label
        out = np.zeros(len(flat), np.uint8)
        label = ends.copy()
        rows = np.arange(len(of))
        for t in range(len(active) - 1, -1, -1):
            n = int(active[t])
            out[first[:n] + t] = label[:n]
            label[:n] = back[t, rows[:n], enters[:n], label[:n]]
        return out

    def gradients(self, ids: np.ndarray, labels: np.ndarray, inside: np.ndarray, listed: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients over lines of words (shape numbers, 0 for the edge), by forward and backward sums."""
        own, before, after, move = self.weights
        rows, steps = ids.shape
        zero = np.zeros((rows, 1), np.int64)
        last, following = np.concatenate((zero, ids[:, :-1]), axis=1), np.concatenate((ids[:, 1:], zero), axis=1)
        said = own[listed].sum(axis=1)[ids] + before[listed].sum(axis=1)[last] + after[listed].sum(axis=1)[following]
        total = lambda x, axis: np.log(np.exp(x - (top := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + top.squeeze(axis)
        ahead = np.empty((steps, rows, LABELS))
        ahead[0] = move[NONE] + said[:, 0]
        for t in range(1, steps):
            new = total(ahead[t - 1][:, :, None] + move, 1) + said[:, t]
            ahead[t] = np.where(inside[:, t, None], new, ahead[t - 1])
        whole = total(ahead[-1], 1)
        behind = np.zeros((steps, rows, LABELS))
        for t in range(steps - 2, -1, -1):
            new = total(move + (said[:, t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(inside[:, t + 1, None], new, behind[t + 1])
        chance = np.exp(ahead + behind - whole[:, None]).transpose(1, 0, 2) * inside[:, :, None]
        true = np.eye(LABELS)[labels] * inside[:, :, None]
        moved = np.zeros_like(move)
        moved[NONE] += (chance[:, 0] - true[:, 0]).sum(axis=0)
        loss = whole - (true * said).sum(axis=(1, 2)) - move[NONE, labels[:, 0]]
        for t in range(1, steps):
            both = np.exp(ahead[t - 1][:, :, None] + move + (said[:, t] + behind[t])[:, None, :] - whole[:, None, None]) * inside[:, t, None, None]
            moved += both.sum(axis=0)
            np.add.at(moved, (labels[:, t - 1], labels[:, t]), -inside[:, t].astype(float))
            loss -= move[labels[:, t - 1], labels[:, t]] * inside[:, t]
        off = chance - true
        grads = []
        for place in (ids, last, following):
            of_shape = np.zeros((len(listed), LABELS))
            np.add.at(of_shape, place, off)
            grads.append(np.zeros_like(own))
            np.add.at(grads[-1], listed, of_shape[:, None, :])
            grads[-1][-1] = 0
        return float(loss.sum()) / rows, [g / rows for g in (*grads, moved)]


def train(lines: list[tuple[list[bytes], list[int]]], seed: int = 5, epochs: int = EPOCHS) -> Field:
    """Fits a field to lines of shapes and labels."""
    rng = np.random.default_rng(seed)
    found = list(dict.fromkeys((b"", *(s for line, _ in lines for s in line))))
    number = {s: i for i, s in enumerate(found)}
    field = Field.fresh(sorted({f for s in found for f in features(s)}))
    listed = field.listed(found)
    first, second, step = [np.zeros_like(w) for w in field.weights], [np.zeros_like(w) for w in field.weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(lines))
        for at in range(0, len(order), BATCH):
            own = [lines[i] for i in order[at : at + BATCH]]
            wide = max(len(s) for s, _ in own)
            ids, labels = np.zeros((2, len(own), wide), np.int64)
            inside = np.zeros((len(own), wide), bool)
            for r, (s, label) in enumerate(own):
                ids[r, : len(s)], labels[r, : len(s)], inside[r, : len(s)] = [number[x] for x in s], label, True
            _, grads = field.gradients(ids, labels, inside, listed)
            step += 1
            for w, g, m, s in zip(field.weights, grads, first, second, strict=True):
                m += 0.1 * (g + 1e-4 * w - m)
                s += 0.01 * (g * g - s)
                w -= 0.1 / (1 + epoch) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return field


def labels_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The kind of each word of the text: that of the first span that it shares a character with."""
    out = []
    for m in WORD.finditer(text):
        out.append(next((k for k, a, z in spans if a < m.end() and m.start() < z), NONE))
    return out


def written_lines() -> list[tuple[list[bytes], list[int]]]:
    """LABELLED as shapes and labels."""
    out = []
    for line in LABELLED:
        text, spans = "", []
        for before, kind, inner in re.findall(r"([^{]*)(?:\{(\w+):([^}]*)\})?", line):
            text += before
            if kind:
                spans.append((KINDS.index(kind) + 1, len(text), len(text) + len(inner)))
                text += inner
        out.append(([s[:SHAPE_BYTES] for s in shapes(text.encode())], labels_of(text, spans)))
    return out


def windows(text: str) -> list[tuple[list[bytes], list[int]]]:
    """What a document teaches: the words around its first spans of each kind and around its first number that is none."""
    spans = base_spans(text)
    label = labels_of(text, spans) if spans else []
    words = [s[:SHAPE_BYTES] for s in shapes(text.encode())]
    label = label or [NONE] * len(words)
    places = [label.index(k) for k in range(1, LABELS) if k in label]
    places += [i for i, (s, k) in enumerate(zip(words, label, strict=True)) if k == NONE and b"d" in s][:1]
    return [(words[max(0, i - SIDE) : i + SIDE + 4], label[max(0, i - SIDE) : i + SIDE + 4]) for i in places or [0] if words]


def lessons(docs: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> list[tuple[list[bytes], list[int]]]:
    """At most so many windows of about so many documents, chosen by a hash of id and text: the same at every call."""
    own = docs.select(F.xxhash64("doc_id", "text").alias("place"), "text").filter("text is not null")
    million = 1_000_000
    share = min(million, sample * million // max(1, own.count()) + 1)

    def run(batches):
        for batch in batches:
            place, n, words, labels = [], [], [], []
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (s, label) in enumerate(windows(text)):
                    place.append(p)
                    n.append(k)
                    words.append(s)
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int32()), pa.array(words, pa.list_(pa.binary())), pa.array(labels, pa.list_(pa.int32()))], ["place", "n", "words", "labels"])

    chosen = own.filter(F.pmod("place", F.lit(million)) < share).mapInArrow(tidied(run), "place long, n int, words array<binary>, labels array<int>")
    return [([bytes(s) for s in r["words"]], list(r["labels"])) for r in chosen.orderBy("place", "n").limit(most).collect()]


def planted(lines: list[tuple[list[bytes], list[int]]], own: list[tuple[list[bytes], list[int]]]) -> list[tuple[list[bytes], list[int]]]:
    """Every second line without personal data once more, with what the labelled lines mark put in, in turn."""
    marked = []
    for words, labels in own:
        edge = [0, *(i for i in range(1, len(labels)) if labels[i] != labels[i - 1]), len(labels)]
        marked += [(words[a:z], labels[a:z]) for a, z in zip(edge, edge[1:], strict=False) if labels[a]]
    out = []
    for k, (words, labels) in enumerate([line for line in lines if not any(line[1])][::2]):
        more, kinds = marked[k % len(marked)]
        at = k // len(marked) % (len(words) + 1)
        out.append((words[:at] + more + words[at:], labels[:at] + kinds + labels[at:]))
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> Field:
    """A field fitted to LABELLED, to the windows of a sample of docs (doc_id, text), and to windows in which LABELLED's data are planted."""
    lines = lessons(docs, sample, most)
    own = written_lines()
    return train(lines + planted(lines, own) + own * max(1, -(-len(lines) // (10 * len(own)))))


def added(text: str, label: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of runs of words of one kind that read as that kind and share nothing with what the rules have found."""
    words = [m.span() for m in WORD.finditer(text)]
    out = []
    edge = np.flatnonzero(np.diff(label.astype(np.int64), prepend=0, append=0))
    for x, y in zip(edge, edge[1:], strict=False):
        kind = int(label[x])
        start, end = words[x][0], words[y - 1][1]
        if kind == NONE or end - start > LONGEST:
            continue
        part = text[start:end]
        if kind == EMAIL:
            found = [m.span() for m in WRITTEN_OUT.finditer(part)]
        else:
            m = re.search(r"[0-9].*[0-9]" if kind != PHONE else r"[+(]?[0-9].*[0-9]", part, re.S)
            read = m[0] if m else ""
            good = kind == PHONE and is_phone(read) and not re.search(r"[^0-9+(). -]", read) or kind == CARD and is_card(read) and not re.search(r"[A-Za-z]", read)
            good = good or kind == IP and len(n := re.findall(r"[0-9]+", read)) == 4 and all(map(small, n)) and "." in read
            found = [m.span()] if m and good else []
        for a, z in found:
            if not any(a + start < q and p < z + start for _, p, q in base):
                out.append((kind, a + start, z + start))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{a}:{z}" for k, a, z in sorted(spans))


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and spans: arrays of struct<kind: string, start: bigint, end: bigint> of what the rules find, and of that and what the field adds.

    Places are code points, the end exclusive; spans are in order of KINDS and start.  docs has
    doc_id and text; other columns are left out.  A null text is an empty one and has no spans;
    repeated rows and null ids each give a row; an empty table gives an empty one.  A long text is
    labelled whole, with memory in proportion to its words.
    """
    held = docs.sparkSession.sparkContext.broadcast((field.names, *field.weights))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    row = lambda spans: [{"kind": KINDS[k - 1], "start": a, "end": z} for k, a, z in sorted(spans)]

    def run(batches):
        own = Field(*held.value)
        for batch in batches:
            for part in parts(batch, PART_DOCS, PART_BYTES):
                texts = part.column(1).to_pylist()
                words = list(map(shapes, part.column(1).cast(pa.binary()).to_pylist()))
                label = own.decode(words)
                edge = np.cumsum([0, *map(len, words)])
                marked = np.add.reduceat(np.append(label, 0) > 0, np.minimum(edge[:-1], len(label))) if len(label) else np.zeros(len(texts))
                base = list(map(base_spans, texts))
                more = [added(t, label[a:z], b) if n and z > a else [] for t, a, z, b, n in zip(texts, edge, edge[1:], base, marked, strict=False)]
                found = [b + m for b, m in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(row, base), pa.list_(span)), pa.array(map(row, found), pa.list_(span))], ["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id long, base {kind}, spans {kind}")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = personal_data(docs, fit(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
