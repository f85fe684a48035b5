"""Secret scans: fixed rules, and a character convolutional network over every other candidate.

The rules find assignments, access keys and long hexadecimal strings. Candidates of the network are the runs of
``[A-Za-z0-9+/_.=-]`` that have 16 or more characters or follow an assignment sign, letters alone and digits
alone included; it reads the whole run and 32 characters on either side. It is a convolution over characters
(each marked as inside or outside the run), the maximum of each filter over the window, one hidden layer and
a logistic output, all in numpy. It is trained on labelled findings: those of all documents and generated ones of
known shapes, some in contexts drawn from the documents. In the documents, what a rule finds is a secret, and a run is
none unless it is mixed like a key, which no rule can tell: such runs teach nothing. The findings of the documents are
dealt into parts; in every round each part goes through its own and the generated ones once, from where the last round
ended, and the mean of the parts is where the next begins. Scores are calibrated by a logistic fit on all findings held
back from training, counted by slots of their logit. Long runs after an assignment sign, short ones after it and bare
runs have a threshold each: the highest edge of a slot that still finds ``RECALL`` of every shape of secret held back.

The network only adds spans (kind ``model``) where no rule's span lies; the rules' spans all stay.

Edge cases: null or empty text has no span; repeated rows and null ids each keep their row; overlapping
spans of different kinds are all listed; a corpus without any finding trains on the generated ones alone.
"""

from __future__ import annotations

import copy
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselink.llm.common import id_and_text, run_folder, slices, stored, tidy

KINDS = ("assign", "access", "hex", "model")
#: Generated findings stand in contexts of at most so many findings of either label, drawn from all.
CONTEXTS = 1500
#: Findings of the documents that one task learns from, and how often all are gone through.
PART_FINDINGS, ROUNDS = 3000, 12
#: Slots of a logit in which held back findings are counted; logits beyond the last one count in it.
SLOTS, LAST_LOGIT = 256, 64
RECALL = 0.95
LEAST_RUN, CONTEXT = 16, 32
WIDTH, FILTERS, HIDDEN = 7, 40, 16
GROUPS = ("assigned", "short", "bare")
LEAST_SHAPE = 10

# The rules.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_LEAST = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX_LEAST = 24

_HEX, _RUN, _SIGN, _GAP = (np.zeros(129, bool) for _ in range(4))
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True
_SIGN[[ord(":"), ord("=")]] = True
_GAP[[ord(" "), ord('"'), ord("'")]] = True


def _runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of True of ``least`` or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    long = ends - begins >= least
    return begins[long], ends[long]


@dataclass
class Scan:
    """Spans of a slice of texts: per rule (text, begin, end), and the runs that no rule's span touches."""

    joined: str
    starts: np.ndarray
    spans: list[tuple[int, int, int, int]]
    candidates: list[tuple[int, int, int]]


def scan(texts: list[str]) -> Scan:
    """Rules and candidates of all texts; positions are code points of each text."""
    joined = "\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), 128).astype(np.uint8)
    found: list[tuple[int, int, int, int]] = []

    def add(kind: int, begin: int, end: int) -> None:
        text = int(np.searchsorted(starts, begin, "right")) - 1
        found.append((text, int(begin - starts[text]), kind, int(end - starts[text])))

    signs = np.flatnonzero(_SIGN[codes])
    for i in np.unique(np.searchsorted(starts, signs, "right") - 1):
        for m in _ASSIGN.finditer(texts[i]):
            if len(m[2]) >= _ASSIGN_LEAST:
                found.append((int(i), m.start(), 0, m.end()))
    for m in _ACCESS.finditer(joined):
        add(1, m.start(), m.end())
    for begin, end in zip(*_runs(_HEX[codes], _HEX_LEAST)):
        add(2, begin, end)
    found.sort()

    begins, ends = _runs(_RUN[codes], 1)
    # A run is assigned if it holds a sign, or if only blanks and quotes stand between it and one.
    equals = np.concatenate([[0], np.cumsum(codes == ord("="))])
    inner = equals[np.maximum(ends - 1, begins + 1)] > equals[begins + 1]
    quiet = np.flatnonzero(~_GAP[codes])
    before = np.concatenate([[-1], quiet])[np.searchsorted(quiet, begins)]
    wanted = (ends - begins >= LEAST_RUN) | inner | ((before >= 0) & _SIGN[codes[before]])
    begins, ends = begins[wanted], ends[wanted]
    taken = sorted((int(starts[t]) + a, int(starts[t]) + b) for t, a, _, b in found)
    candidates, last, k = [], -1, 0
    for begin, end in zip(begins.tolist(), ends.tolist()):
        while k < len(taken) and taken[k][0] < end:
            last = max(last, taken[k][1])
            k += 1
        if last <= begin:
            text = int(np.searchsorted(starts, begin, "right")) - 1
            candidates.append((text, begin - int(starts[text]), end - int(starts[text])))
    return Scan(joined, starts, [(t, a, b, kind) for t, a, kind, b in found], candidates)


@dataclass
class Finding:
    before: str
    run: str
    after: str

    @property
    def group(self) -> str:
        if re.search(r"[:=][\"' ]*$", self.before) or re.match(r"[A-Za-z_]+=", self.run):
            return "assigned" if len(self.run) >= LEAST_RUN else "short"
        return "bare"

    @property
    def keylike(self) -> bool:
        """Whether the run changes between small, capital letters and digits as often as a drawn key does."""
        kinds = [c.isdigit() + 2 * c.isupper() for c in self.run if c.isalnum()]
        changes = sum(x != y for x, y in zip(kinds, kinds[1:]))
        return len(kinds) >= 6 and changes >= 0.25 * len(kinds)


def _finding(text: str, begin: int, end: int) -> Finding:
    return Finding(text[max(0, begin - CONTEXT) : begin], text[begin:end], text[end : end + CONTEXT])


# --- the network --------------------------------------------------------------------------------

_SYMBOLS = 131  # 128 ASCII, others, window edge
_WEIGHTS = ("filters", "bias", "dense", "dense_bias", "out", "out_bias")


def _windows(findings: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all windows one after another, with room for the filter between them, and where each begins."""
    parts, begins, at = [], [], 0
    edge = np.full(WIDTH - 1, 130)
    for f in findings:
        text = f.before + f.run + f.after
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 129).astype(np.int64)
        codes[len(f.before) : len(f.before) + len(f.run)] += _SYMBOLS
        parts += [edge, codes]
        begins.append(at)
        at += len(edge) + len(codes)
    return np.concatenate([*parts, edge]), np.array(begins)


class Network:
    """Filters over characters, their maximum over a window, a hidden layer, a logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.filters = r.normal(0, 0.15, (WIDTH, 2 * _SYMBOLS, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.dense, self.dense_bias = r.normal(0, 0.4, (FILTERS, HIDDEN)), np.zeros(HIDDEN)
        self.out, self.out_bias = r.normal(0, 0.4, HIDDEN), np.zeros(1)
        self.slope, self.shift = 1.0, 0.0
        self.thresholds = dict.fromkeys(GROUPS, 0.5)

    def _forward(self, findings: list[Finding]):
        symbols, begins = _windows(findings)
        n = len(symbols) - WIDTH + 1
        response = np.zeros((n, FILTERS))
        for k in range(WIDTH):
            response += self.filters[k, symbols[k : k + n]]
        top = np.maximum.reduceat(response, begins, axis=0)
        pooled = np.maximum(top + self.bias, 0)
        hidden = np.maximum(pooled @ self.dense + self.dense_bias, 0)
        return symbols, begins, response, top, pooled, hidden, hidden @ self.out + self.out_bias

    def logits(self, findings: list[Finding], at_once: int = 500) -> np.ndarray:
        parts = [self._forward(findings[k : k + at_once])[-1] for k in range(0, len(findings), at_once)]
        return np.concatenate([np.zeros(0), *parts])

    def scores(self, findings: list[Finding]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(findings) + self.shift)))

    def secret(self, findings: list[Finding]) -> np.ndarray:
        least = np.array([self.thresholds[f.group] for f in findings])
        return self.scores(findings) >= least if findings else np.zeros(0, bool)

    def state(self) -> list[np.ndarray]:
        """The weights, and both moments of each for a training that begins."""
        weights = [getattr(self, k).copy() for k in _WEIGHTS]
        return weights + [np.zeros_like(w) for w in weights * 2]

    def train(
        self, findings: list[Finding], labels: np.ndarray, epochs: int = ROUNDS, batch: int = 64, rate: float = 0.01, seed=7, state: list[np.ndarray] | None = None, step: int = 0
    ) -> list[np.ndarray]:
        """Train on from ``state``, which ``step`` batches led to, or from the weights as they are; returns the state reached."""
        r = np.random.default_rng(seed)
        names, n = _WEIGHTS, len(_WEIGHTS)
        state = self.state() if state is None else state
        for k, w in zip(names, state):
            getattr(self, k)[...] = w
        m, v = dict(zip(names, state[n : 2 * n])), dict(zip(names, state[2 * n :]))
        for _ in range(epochs):
            order = r.permutation(len(findings))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                grads = self._gradients([findings[i] for i in part], labels[part])
                step += 1
                for name, g in zip(names, grads):
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    getattr(self, name)[...] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return [*(getattr(self, k) for k in names), *m.values(), *v.values()]

    def _gradients(self, findings: list[Finding], labels: np.ndarray):
        symbols, begins, response, top, pooled, hidden, logit = self._forward(findings)
        d_logit = (1 / (1 + np.exp(-logit)) - labels) / len(labels)
        d_hidden = np.outer(d_logit, self.out) * (hidden > 0)
        d_pooled = (d_hidden @ self.dense.T) * (pooled > 0)
        ends = np.append(begins[1:], len(response))
        d_filters = np.zeros_like(self.filters)
        # Only the place of each filter's maximum carries a gradient.
        place = np.stack([begins[i] + response[begins[i] : ends[i]].argmax(0) for i in range(len(begins))])
        column = np.broadcast_to(np.arange(FILTERS), place.shape)
        for k in range(WIDTH):
            np.add.at(d_filters[k], (symbols[place + k], column), d_pooled)
        return d_filters, d_pooled.sum(0), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ d_logit, np.array([d_logit.sum()])

    def slots(self, findings: list[Finding]) -> np.ndarray:
        """The slot of each finding's logit."""
        return np.floor(np.clip(self.logits(findings), -LAST_LOGIT, LAST_LOGIT) * SLOTS).astype(np.int64)

    def calibrate(self, counts: Counter[tuple[str, str, int, int]], recall: float) -> None:
        """Fit slope and shift of the logistic output, then each group's highest threshold of the wanted recall.

        ``counts`` has the number of findings of each (group, shape, label, slot). A shape of secrets that a group holds
        ``LEAST_SHAPE`` of or more has the recall by itself.
        """
        rows = sorted(counts.items())
        logit = np.array([(slot + 0.5) / SLOTS for (_, _, _, slot), _ in rows])
        labels = np.array([label for (_, _, label, _), _ in rows], float)
        share = np.array([n for _, n in rows], float)
        share /= share.sum()
        for _ in range(300):
            error = share * (1 / (1 + np.exp(-(self.slope * logit + self.shift))) - labels)
            self.slope -= 0.1 * float((error * logit).sum()) / max(1.0, float((share * logit**2).sum()))
            self.shift -= 0.1 * float(error.sum())
        for group in GROUPS:
            hits: dict[str | None, Counter[int]] = {}
            for (of, shape, label, slot), n in rows:
                if label == 1 and of == group:
                    for key in (None, shape):
                        hits.setdefault(key, Counter())[slot] += n
            least = []
            for found in hits.values():
                at, n = np.array(sorted(found.items())).T
                if n.sum() >= LEAST_SHAPE:
                    least.append(int(at[np.searchsorted(np.cumsum(n), int((1 - recall) * n.sum()), "right")]))
            if least:
                edge = -np.inf if min(least) <= -LAST_LOGIT * SLOTS else min(least) / SLOTS
                self.thresholds[group] = float(1 / (1 + np.exp(-(self.slope * edge + self.shift))))


# --- labelled findings --------------------------------------------------------------------------


def generated_findings(contexts: list[Finding], n: int, seed: int = 11) -> tuple[list[Finding], list[int], list[str]]:
    """Secrets of known shapes and look-alikes that are none, with their shapes; half of them in contexts of the corpus."""
    r = random.Random(seed)
    letters, alnum = string.ascii_lowercase, string.ascii_letters + string.digits
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick(letters, r.randint(2, 9))
    secrets = {
        "prefixed": lambda: "ghp_" + pick(alnum, 36),
        "payment": lambda: "sk_live_" + pick(alnum, 24),
        "chat": lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24),
        "maps": lambda: "AIza" + pick(alnum + "_-", 35),
        "signed": lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum + "_-", 40) + "." + pick(alnum + "_-", 30),
        "base64": lambda: pick(alnum + "+/", r.choice([28, 40, 64])) + r.choice(["", "=", "=="]),
        "plain": lambda: pick(alnum, r.randint(20, 48)),
        "hex": lambda: pick("0123456789ABCDEF", r.choice([32, 40, 64])),
    }
    # Short ones are secrets by their name only.
    named = ["pwd: ", "pass = ", "passphrase: ", 'auth="', "credential: ", "private_key=", "PIN: "]
    plain = ["note: ", "name = ", "see: ", "total: ", "id: ", 'class="', "date: ", "ref=", "time: ", "page: ", "url: ", "c: "]
    short = [lambda: pick(alnum, r.randint(6, 15)), lambda: pick(letters, r.randint(6, 12)) + str(r.randint(0, 999)), lambda: pick(string.digits, r.randint(4, 8))]
    usual = [word, lambda: word().capitalize(), lambda: str(r.randint(0, 99999)), lambda: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: word() + ".", lambda: word() + "-" + word(), lambda: word() + str(r.randint(0, 99))]
    others = [
        lambda: "-".join(word() for _ in range(4)) + "-" + str(r.randint(1, 2030)),
        lambda: "_".join(word() for _ in range(4)) + str(r.randint(0, 99)),
        lambda: "/".join([word(), word(), str(r.randint(2000, 2030)), word() + ".html"]),
        lambda: f"{word()}.{word()}.{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{word()}",
        lambda: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}Z",
        lambda: pick(letters, r.randint(15, 30)) + str(r.randint(0, 9)),
        lambda: (word() + word() + word()).ljust(16, "a").capitalize() + str(r.randint(0, 999)),
        lambda: f"{word()}{r.randint(1, 99)}={word()}-{word()}-{word()}",
        lambda: "www." + word() + word() + ".com/" + word() + str(r.randint(1, 9999)),
        lambda: pick(string.digits, r.randint(8, 16)) + "-" + word() + "-" + word(),
        lambda: pick(letters, r.randint(16, 40)) + r.choice(["", ".", "..."]),
        lambda: pick(letters, r.randint(16, 40)).upper() + r.choice(["", ".", "..."]),
        lambda: pick(string.digits, r.randint(16, 24)),
        lambda: r.choice("-=._") * r.randint(16, 40),
    ]
    found, labels, shapes = [], [], []
    for i in range(n):
        label = i % 2
        brief = r.random() < 0.25
        shape = "named" if brief else r.choice(list(secrets))
        run = r.choice(short if label else usual)() if brief else secrets[shape]() if label else r.choice(others)()
        if contexts and r.random() < 0.5:
            at = r.choice(contexts)
            before, after = at.before, at.after
        else:
            before, after = " ".join(word() for _ in range(6)) + " ", " " + " ".join(word() for _ in range(6))
        if brief:
            before = before[:-16] + " " + r.choice(named if label else plain)
        elif r.random() < 0.3:
            before = before[:-12] + r.choice(["key: ", "auth=", 'value = "', "id: ", "ref=", "name = "])
        found.append(Finding(before[-CONTEXT:], run, after[:CONTEXT]))
        labels.append(label)
        shapes.append(shape)
    return found, labels, shapes


def corpus_findings(docs: DataFrame) -> DataFrame:
    """(label, before, run, after) of all documents: what a rule finds, and runs unlike any key; each finding once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            got = scan(texts)
            rule = {(t, *_token(texts[t], a, b)) for t, a, b, _ in got.spans}
            rows = [(1, _finding(texts[t], a, b)) for t, a, b in sorted(rule)] + [(0, f) for f in (_finding(texts[t], a, b) for t, a, b in got.candidates) if not f.keylike]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in rows], pa.int32()), *(pa.array([getattr(f, k) for _, f in rows], pa.string()) for k in ("before", "run", "after"))],
                ["label", "before", "run", "after"],
            )

    found = id_and_text(docs).mapInArrow(run, "label int, before string, run string, after string").distinct()
    return stored(found, run_folder(docs.sparkSession, "secret_scan"), "labelled")


def _drawn(found: DataFrame) -> tuple[list[Finding], list[int]]:
    chosen = [found.filter(F.col("label") == k).orderBy(F.xxhash64("before", "run", "after"), "before", "run", "after").limit(CONTEXTS).collect() for k in (0, 1)]
    rows_ = [r for rows in chosen for r in rows]
    return [Finding(r["before"], r["run"], r["after"]) for r in rows_], [r["label"] for r in rows_]


def labelled_findings(docs: DataFrame) -> tuple[list[Finding], list[int]]:
    """A bounded number of either label of ``corpus_findings``, drawn by digest, for contexts of generated ones."""
    return _drawn(corpus_findings(docs))


def _token(text: str, begin: int, end: int) -> tuple[int, int]:
    """The value of an assignment, without its name; other spans as they are."""
    m = _ASSIGN.match(text[begin:end])
    return (begin + m.start(2), begin + m.end(2)) if m else (begin, end)


def _findings(table: pa.Table | pa.RecordBatch) -> list[Finding]:
    return [Finding(*x) for x in zip(*(table.column(k).to_pylist() for k in ("before", "run", "after")))]


def _mean_of_parts(dealt: DataFrame, network: Network, state: list[np.ndarray], step: int, more: list[Finding], their: np.ndarray, seed: int) -> list[np.ndarray]:
    """The state after one round: each part trains from ``state`` on its findings and ``more``; the mean by numbers of findings."""
    shared = dealt.sparkSession.sparkContext.broadcast((network, state, more, their))

    def run(part: pa.Table) -> pa.Table:
        net, start, more, their = copy.deepcopy(shared.value)
        number = part.column("part")[0].as_py()
        part = part.filter(pc.is_valid(part.column("label"))).sort_by([(k, "ascending") for k in ("run", "before", "after", "label")])
        findings, labels = _findings(part) + more, np.concatenate([np.array(part.column("label").to_pylist(), float), their])
        reached = net.train(findings, labels, 1, seed=[seed, step, number], state=start, step=step) if findings else start
        n = max(1, len(findings))
        return pa.table({"state": pa.array([np.concatenate([n * x.ravel() for x in reached]).tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    ended = dealt.groupBy("part").applyInArrow(run, "state binary, n long").rdd
    total, n = ended.map(lambda r: (np.frombuffer(r["state"]), r["n"])).treeReduce(lambda x, y: (x[0] + y[0], x[1] + y[1]))
    ends = np.cumsum([x.size for x in state])
    return [x.reshape(was.shape) for x, was in zip(np.split(total / n, ends[:-1]), state)]


def _counted(network: Network, findings: list[Finding], labels: list[int], shapes: list[str]) -> Counter[tuple[str, str, int, int]]:
    return Counter((f.group, shape, int(label), int(slot)) for f, label, shape, slot in zip(findings, labels, shapes, network.slots(findings)))


def _counted_corpus(held: DataFrame, network: Network) -> Counter[tuple[str, str, int, int]]:
    """All held back findings of the documents by (group, shape, label, slot of the logit)."""
    shared = held.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            findings = _findings(batch)
            found = _counted(shared.value, findings, batch.column("label").to_pylist(), ["corpus"] * len(findings))
            columns = [pa.array([k[i] for k in found], kind) for i, kind in ((0, pa.string()), (2, pa.int32()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.int64())], ["group", "label", "slot", "n"])

    rows = held.mapInArrow(run, "group string, label int, slot long, n long").groupBy("group", "label", "slot").agg(F.sum("n").alias("n")).collect()
    return Counter({(r["group"], "corpus", r["label"], r["slot"]): r["n"] for r in rows})


def train(docs: DataFrame, generated: int = 6000, seed: int = 5) -> Network:
    """A trained and calibrated network; two of three findings train it, the others set its thresholds."""
    found = corpus_findings(docs)
    more, their, shapes = generated_findings(_drawn(found)[0], generated)
    order = np.random.default_rng(seed).permutation(len(more))
    learnt, rest = order[: len(order) * 2 // 3], order[len(order) * 2 // 3 :]
    digest = lambda start, n: F.pmod(F.xxhash64(F.lit(start), "label", "before", "run", "after"), F.lit(n))
    held = digest("held", 3) == 0
    parts = max(1, math.ceil(found.filter(~held).count() / PART_FINDINGS))
    # A part without a finding goes through the generated ones.
    every = docs.sparkSession.range(parts).selectExpr("id as part", "cast(null as int) as label", "'' as before", "'' as run", "'' as after")
    dealt = found.filter(~held).withColumn("part", digest("part", parts)).unionByName(every)
    network = Network()
    state, labels = network.state(), np.array([their[i] for i in learnt], float)
    batches = math.ceil((PART_FINDINGS + len(learnt)) / 64)
    for k in range(ROUNDS):
        state = _mean_of_parts(dealt, network, state, k * batches, [more[i] for i in learnt], labels, seed)
    for name, weights in zip(_WEIGHTS, state):
        getattr(network, name)[...] = weights
    counts = _counted(network, [more[i] for i in rest], [their[i] for i in rest], [shapes[i] for i in rest])
    network.calibrate(counts + _counted_corpus(found.filter(held), network), RECALL)
    return network


# --- over documents -----------------------------------------------------------------------------


def spans_of(texts: list[str], network: Network) -> list[list[tuple[int, int, int]]]:
    """(begin, kind, end) of every span of each text, by begin and kind."""
    got = scan(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, a, b, kind in got.spans:
        out[t].append((a, kind, b))
    secret = network.secret([_finding(texts[t], a, b) for t, a, b in got.candidates])
    for (t, a, b), yes in zip(got.candidates, secret):
        if yes:
            out[t].append((a, 3, b))
    return [sorted(s) for s in out]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_secrets(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            spans = spans_of(texts, shared.value)
            count = [[sum(k == kind for _, k, _ in s) for s in spans] for kind in range(4)]
            base = [hashlib.sha256(_listed([x for x in s if x[1] < 3]).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in count[:3]),
                    pa.array(base, pa.string()),
                    pa.array([_listed(s) for s in spans], pa.string()),
                    pa.array(count[3], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"
    )


def redact(docs: DataFrame, network: Network, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; all other columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.schema.names.index(text_col)
            kind = whole.schema.field(place).type
            keyed = whole.rename_columns([f"_{i}" for i in range(whole.num_columns)]).append_column("text", whole.column(place))
            for batch, texts in slices([keyed]):
                null = batch.column("text").is_null().to_pylist()
                new = [None if n else cut(t, s) for n, t, s in zip(null, texts, spans_of(texts, shared.value))]
                columns = batch.columns[:-1]
                columns[place] = pa.array(new, pa.string()).cast(kind)
                yield pa.RecordBatch.from_arrays(columns, whole.schema.names)

    return docs.mapInArrow(tidy(run), T.StructType(docs.schema.fields))


def secret_spans(docs: DataFrame) -> DataFrame:
    return find_secrets(docs, train(docs))
