"""Personal data in text: fixed patterns, and a skip-chain conditional random field that adds what repeats them.

The field has a node for each token with a digit or an @ (all other tokens are observed as outside), labels outside, email,
ip, card and phone, edges between neighbouring nodes, and skip edges between repeated or similar nodes of a document,
however distant: equal texts, equal digits, or digits that belong to a longer number found by the patterns.  Nodes
under a pattern's match are observed, and repeats of an observed node are tied to the nearest one; for the others loopy message passing gives marginals, so a number written
otherwise than the patterns ask takes the label of its likes.  Weights are learned here, by pseudo-likelihood on a bounded
sample of documents with the patterns' matches as labels and features left out at random.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.common import map_arrow, map_texts, pieces, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)

# Fixed patterns, anchored so that no text takes more than linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"(?:^|(?<=\s))[^\s0-9@]*[0-9@]\S*")
ANY = re.compile(r"[0-9@]")
NOT_DIGITS = re.compile(r"[^0-9]+")
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|=~^_/\\"
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "pay"), "phone": ("tel", "phone", "call", "fax", "mobile")}

SAMPLE, SAMPLE_NODES = 2000, 2000  # documents the weights are learned from at most, and nodes of a document that may be one of them
ROUNDS, DAMPING, SETTLED = 5000, 0.5, 1e-3  # rounds stop earlier, document by document, when no message changes by more than SETTLED
ADD_FROM = 0.6  # marginal from which a node becomes a span


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the patterns, by start and kind."""
    found = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            match = DOMAIN.match(text, at + 1) if start < at else None
            if match:
                found.append((start, 0, match.end()))
                done = match.end()
            else:
                done = max(done, at + 1)
            at = text.find("@", max(at + 1, done))
    if ANY.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m.group())
            if len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _features(token: str, before: str, alone_left: bool, alone_right: bool) -> list[int]:
    digits = NOT_DIGITS.sub("", token)
    n = len(digits)
    on = [0, 1 + min(7, (0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 6, 6, 6)[n] if n < 20 else 7)]
    dots, parts = token.count("."), token.split(".")
    flags = ("@" in token, "@" in token and "." in token.partition("@")[2], dots == 3, dots == 3 and all(p.isdigit() and len(p) <= 3 for p in parts), dots > 3,
             n > 11 and luhn(digits), token.startswith("+"), "-" in token, "(" in token or ")" in token, any(c.isalpha() for c in token), n == len(token),
             alone_left, alone_right, *(any(c in before for c in cue) for cue in CUES.values()))
    return on + [9 + i for i, flag in enumerate(flags) if flag]


FEATURES = 9 + 17


class Graph:
    """Nodes and edges of the documents added so far."""

    def __init__(self):
        self.spans, self.x, self.y = [], [], []
        self.chain, self.skip = [], []
        self.document, self.documents = [], 0

    def add(self, text: str, base: list[tuple[int, int, int]]) -> range:
        """The nodes of one document."""
        first = len(self.x)
        same, previous, under = defaultdict(list), -1, 0
        tokens = [m.span() for m in TOKEN.finditer(text)]
        ends = [b for _, b in tokens]
        for i, (a, b) in enumerate(tokens):
            core = text[a:b].strip(EDGES) or text[a:b]
            start = a + text[a:b].find(core)
            node = first + i
            left = previous >= 0 and text[previous:a].isspace()
            right = i + 1 < len(tokens) and text[b:tokens[i + 1][0]].isspace()
            while under < len(base) and base[under][2] <= start:
                under += 1
            label = next((1 + k for s, k, e in base[under:under + 4] if s < start + len(core) and start < e), 0)
            self.spans.append((start, start + len(core)))
            self.x.append(_features(core, text[max(0, a - 24):a].lower(), not left, not right))
            self.y.append(label)
            if left:
                self.chain.append((node - 1, node))
            digits = NOT_DIGITS.sub("", core)
            keys = [core.lower()] + ([digits] if len(digits) >= 6 else [])
            for key in keys:
                same[key].append(node)
            previous = b
        for s, k, e in base:  # parts of a number written in several tokens: look for its tails of 7 digits or more
            digits = NOT_DIGITS.sub("", text[s:e])
            if k and 7 <= len(digits) <= 19:
                i = bisect_right(ends, s)
                if i < len(tokens) and tokens[i][0] < e:
                    for cut in range(len(digits) - 6):
                        if digits[cut:] in same:
                            same[digits[cut:]].append(first + i)
        for nodes in same.values():
            nodes = sorted(set(nodes))
            sure = [node for node in nodes if self.y[node]]
            for a, b in zip(sure or nodes, (sure or nodes)[1:]):
                self.skip.append((a, b))
            for node in nodes if sure else ():
                if not self.y[node]:
                    at = bisect_left(sure, node)
                    near = min(sure[max(0, at - 1):at + 1], key=lambda other: abs(other - node))
                    self.skip.append((min(near, node), max(near, node)))
        self.document.extend([self.documents] * len(tokens))
        self.documents += 1
        return range(first, len(self.x))


def _design(x: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(x), FEATURES), np.float32)
    for row, on in zip(out, x):
        row[on] = 1
    return out


class Field:
    """Weights of the field: of features (``unary``), of neighbours (``chain``) and of repeated tokens (``skip``)."""

    def __init__(self):
        self.unary = np.zeros((FEATURES, LABELS))
        self.unary[0, 0] = 3.0
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = 2.0 * np.eye(LABELS)

    def learn(self, x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300, rate: float = 0.05) -> "Field":
        """Pseudo-likelihood: each label given its features and its neighbours' labels, a fifth of the features left out anew each step."""
        if not len(y):
            return self
        rng = np.random.default_rng(0)
        start = [w.copy() for w in (self.unary, self.chain, self.skip)]
        weights = [self.unary, self.chain, self.skip]
        gold = np.eye(LABELS)[y]
        near = []
        for edges in (chain, skip):
            seen = np.zeros((len(y), LABELS))
            np.add.at(seen, edges[:, 0], gold[edges[:, 1]])
            np.add.at(seen, edges[:, 1], gold[edges[:, 0]])
            near.append(np.minimum(seen, 2))
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            kept = x * (rng.random(x.shape) > 0.2)
            kept[:, 0] = 1
            inputs = (kept, *near)
            z = sum(i @ w for i, w in zip(inputs, weights))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = p / p.sum(axis=1, keepdims=True) - gold
            for k, (i, w) in enumerate(zip(inputs, weights)):
                g = i.T @ error / len(y) + 1e-3 * (w - start[k])
                if k:
                    g = (g + g.T) / 2
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy message passing over all documents of the graph at once; observed nodes keep their label."""
        n = len(graph.x)
        log = _design(graph.x) @ self.unary
        y = np.array(graph.y, np.int64)
        log[y > 0] = -1e12  # more than any number of messages can outweigh
        log[y > 0, y[y > 0]] = 0
        pairs = [(np.array(e, np.int64).reshape(-1, 2), w) for e, w in ((graph.chain, self.chain), (graph.skip, self.skip))]
        source = np.concatenate([e[:, k] for e, _ in pairs for k in (0, 1)])
        target = np.concatenate([e[:, 1 - k] for e, _ in pairs for k in (0, 1)])
        back = np.concatenate([np.arange(len(e)) + offset for e, offset in _opposite([len(e) for e, _ in pairs])]) if len(source) else np.empty(0, np.int64)
        table = np.concatenate([np.broadcast_to(np.exp(w - w.max()), (2 * len(e), LABELS, LABELS)) for e, w in pairs])
        messages = np.zeros((len(source), LABELS))
        document = np.array(graph.document, np.int64)
        live, nodes = np.arange(len(source)), np.arange(n)
        for _ in range(ROUNDS):
            if not len(live):
                break
            belief = np.zeros_like(log)
            belief[nodes] = log[nodes]
            np.add.at(belief, target[live], messages[live])
            cavity = belief[source[live]] - messages[back[live]]
            cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", cavity, table[live]) + 1e-30)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages[live]).max(axis=1)
            messages[live] = DAMPING * messages[live] + (1 - DAMPING) * new
            moving = np.zeros(graph.documents, bool)
            moving[document[target[live[change >= SETTLED]]]] = True
            live, nodes = live[moving[document[target[live]]]], nodes[moving[document[nodes]]]
        belief = log.copy()
        if len(source):
            np.add.at(belief, target, messages)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
        return belief / belief.sum(axis=1, keepdims=True) if n else belief

    def spans(self, values: list[str]) -> list[tuple[list, list]]:
        """For each text the patterns' spans and all spans, as (start, kind, end)."""
        graph, found = Graph(), []
        for text in values:
            base = base_spans(text)
            found.append((base, graph.add(text, base) if ANY.search(text) else range(0)))
        p = self.marginals(graph) if graph.x else np.empty((0, LABELS))
        best = p.argmax(axis=1) if len(p) else p
        out = []
        for base, nodes in found:
            added = [(graph.spans[i][0], int(best[i]) - 1, graph.spans[i][1]) for i in nodes if not graph.y[i] and best[i] and p[i, best[i]] >= ADD_FROM]
            out.append((base, sorted(base + added)))
        return out


def _opposite(sizes: list[int]):
    """Each edge has a message there and one back, stored one block after the other."""
    offset = 0
    for n in sizes:
        yield np.arange(n), offset + n
        yield np.arange(n), offset
        offset += 2 * n


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn the field on at most ``sample`` documents, chosen by a hash of the id, that hold a digit or an @.

    A document with more than SAMPLE_NODES nodes is no part of the sample; it is searched like any other.  Without any
    sample the starting weights stay.
    """
    candidates = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text rlike '[0-9@]'")
    ids = candidates.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batch: pa.RecordBatch) -> dict:
        out = {"x": [], "y": [], "chain": [], "skip": []}
        for text in batch.column(1).to_pylist():
            graph = Graph()
            graph.add(text, base_spans(text))
            if len(graph.x) <= SAMPLE_NODES:
                out["x"].append(_design(graph.x).astype(np.uint8).tobytes())
                for name in ("y", "chain", "skip"):
                    out[name].append(np.array(getattr(graph, name), np.int32).tobytes())
        return out

    rows = map_texts(texts(candidates).join(F.broadcast(ids), "doc_id").select("doc_id", "text"), run, "x binary, y binary, chain binary, skip binary").collect()
    rows.sort()
    x, y, edges, n = [], [], {"chain": [], "skip": []}, 0
    for r in rows:
        y.append(np.frombuffer(r["y"], np.int32))
        x.append(np.frombuffer(r["x"], np.uint8).reshape(-1, FEATURES))
        for name, found in edges.items():
            found.append(np.frombuffer(r[name], np.int32).reshape(-1, 2) + n)
        n += len(y[-1])
    if not n:
        return Field()
    return Field().learn(np.concatenate(x).astype(np.float64), np.concatenate(y), np.concatenate(edges["chain"]).astype(int), np.concatenate(edges["skip"]).astype(int))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and hash are of the patterns' matches, ``spans`` has the field's as well; places are code points, end exclusive.
    Null and empty texts have no spans (the hash of an empty string).  Rows that repeat a doc_id are searched each.  Empty
    table: no rows.
    """
    def run(batch: pa.RecordBatch) -> dict:
        found = field.spans(batch.column(1).to_pylist())
        out = {"doc_id": batch.column(0)} | {f"n_{kind}": [sum(s[1] == k for s in base) for base, _ in found] for k, kind in enumerate(KINDS)}
        out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
        return out | {"spans": [written(every) for _, every in found]}

    return map_texts(texts(docs), run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out.append(text[at:a] + f"<{KINDS[k].upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """``docs``, all rows and columns, with personal data masked in ``text``, and ``n_chars``, where there is one, counted anew."""
    fields = docs.schema
    at = fields.names.index("text")
    size = fields.names.index("n_chars") if "n_chars" in fields.names else None

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                values = part.column(at).to_pylist()
                found = field.spans([t or "" for t in values])
                new = [None if t is None else masked(t, every) for t, (_, every) in zip(values, found)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if size is not None:
                    old = part.column(size).to_pylist()
                    columns[size] = pa.array([n if t == o else len(t) for n, t, o in zip(old, new, values)], part.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_arrow(docs, run, fields)
