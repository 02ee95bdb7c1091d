"""PII: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Base spans come from four patterns, leftmost and non-overlapping for each kind. The random field labels
the tokens around those that hold a digit or an "@" (no other token can be part of a span) from the
shapes of a token and its neighbours; it is trained here from the small labelled table below and decoded
by Viterbi in numpy for all sequences of a batch at once. Its spans are added unless they touch a base
span: addresses in domains with letters beyond ASCII, telephone numbers without a plus sign, cards of 13 to 15
digits. Where two of a kind follow one another, each is a span of its own. The kinds are these four;
names, postal addresses, keys and other secrets are none of them.

Nulls and edges: a null or empty text has no spans; texts and tokens of any length are read whole, in
pieces of lines for memory; rows that repeat are ordinary, each gives its row; of tag sequences with
equal scores the one with the smaller tags counts; offsets count code points, the end exclusive; an
empty table gives an empty result. Columns named as those added here are replaced.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive and tied to the start of a run of digits: the same matches as [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), in linear time
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
#: Tokens end at white space and at marks that no span holds.
TOKEN = re.compile(r"[^\s,;|\"'`<>{}\[\]=]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > last and text[low - 1] in LOCAL:
            low -= 1
        m = DOMAIN.match(text, at + 1) if low < at else None
        if m:
            yield low, m.end()
        last = m.end() if m else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind and start."""
    if not TRIGGER.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


#: The labelled table is built from these: values of each kind, each put into two of its kind's contexts, and text without spans.
CONTEXTS = {
    "email": ("write to {} today", "mail {}, please", "contact: {}.", "<{}> wrote", "send it to {} now", "reach me at {} or by post", "from {} on Monday", "address {}; copy to us"),
    "phone": ("call {} now", "phone {} after six", "tel. {}, office", "fax {} only", "ring {} for help", "my number is {} ok", "number {} in Paris", "reach me at {} today", "mobile: {}", "{} is my line", "{}", "Handy {} bitte"),
    "ip": ("from {} port", "host {} is up", "address {}, then", "server {} failed", "login by {} at night", "ping {} twice"),
    "card": ("card {} expires", "card {} used", "pay with {} please", "visa {} ok", "charged to {} again", "number {} on file", "{}", "my card is {}", "amex {} was refused"),
}
VALUES = {
    "email": ("jane.doe@mail.example.org", "bob_1@corp.example.com", "a+b@x.example.net", "max@müller.example.de", "info@example.co.uk", "ursula@düren.example.com", "jo.gross@straße.example.de", "renee@société.example.fr", "n77@köln.example.de", "jose-luis@españa.example.es"),
    "phone": (
        "+1 (555) 010-2345", "(555) 010-9876", "555-010-4477", "+49 30 1234567", "(212) 555-0199", "1-800-555-0142", "0171 5550123", "+33 1 23 45 67 89", "(020) 7946 0991", "030/5550147", "0049 30 5550199", "212-555-0163",
        "(0711) 555-0118", "06 12 34 56 78", "0171-5550188", "(415) 555 0132", "0172 5551 2345", "0221 555018", "(030) 5550 122",
    ),
    "ip": ("192.168.10.4", "10.0.0.1", "8.8.4.4", "172.16.254.1"),
    "card": ("4111 1111 1111 1111", "4111-1111-1111-1111", "4012888888881881", "5500 0000 0000 0004", "378282246310005", "371449635398431", "3782 822463 10005", "30569309025904", "6011111111111117", "4222222222222"),
}
WITHOUT = (
    "in 2024 we sold 1200 units", "on 2024-01-15 at 10:30 am", "version 1.2.3 is out", "it costs 1,234.56 euros", "chapter 12 page 340", "order 20391847 shipped", "from 1990 to 1995, about 40",
    "at 12:45:10 he left", "ISBN 978-3-16-148410-0 here", "ISBN 3-598-21508-8", "isbn 0-19-852663-6 of 1998", "score 3-2 after 90 minutes", "the @ sign and #1 tag", "follow @someone there", "about 5.5 or 10.25 percent", "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"",
    "section 4.2.1.7 of part 3", "id 123456789 and 987654321", "room 101 and 102", "top 10 of 100", "see [12] and (34)", "x1 y2 z3", "a3f9 00ff 12ab", "10% of 20%", "1st 2nd 3rd", "order 2086184495729368 shipped", "the number 9859476043669043 of parts",
    "on file 4183418637171908 since May", "words 0007687199101951 and more", "parcel 7663683147833396 is lost", "item 37828224631000 sold", "sum 371449635398430 in all", "serial 5000677111630122 of it", "years 1914 1918 1939 1945", "pages 12 34 56 78 of it", "2 000 000 of them",
    "on 12/05/2019 or 13/05", "weights 60 61 62 kg", "rows 100-200 and 300-400", "build 10.0.19045 came", "rfc 2616 section 14.9.1", "at 50 km/h for 30 min", "about (12) of (13)", "route 66 to mile 120",
)
LABELLED = (
    *(contexts[(k + j) % len(contexts)].replace("{}", f"[{kind}:{value}]") for kind, contexts in CONTEXTS.items() for k, value in enumerate(VALUES[kind]) for j in (0, 3)), *WITHOUT,
)
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
EDGE_L, EDGE_R = re.compile(r"^[^\w+(@]+"), re.compile(r"[^\w)]+$")


def shape(token: str) -> tuple[str, ...]:
    """The features of a token's form: its compressed shape, its digits, and its marks. A run of digits as long as a
    card's tells whether its check digit is right."""
    core = EDGE_R.sub("", EDGE_L.sub("", token))
    s, kind, run = [], "", 0
    for c in core:
        k = "9" if c.isdigit() else "x" if c.isalpha() else c if c in "@.+-()_:/,%" else "?"
        run = run + 1 if k == kind else 1
        if k != kind:
            s.append(k)
        elif k == "9" and run in (2, 3, 4, 5, 8, 13, 16, 20):
            s[-1] = f"9{run}"
        kind = k
    d = sum(c.isdigit() for c in core)
    check = luhn(core) if 13 <= d <= 19 and len(core) == d and core.isascii() else None
    return (
        "s=" + "".join(s), f"d={0 if not d else 1 if d < 3 else 3 if d == 3 else 4 if d == 4 else 5 if d < 8 else 8 if d < 13 else 13 if d < 16 else 16 if d < 20 else 20}",
        f"@={'@' in core}", f".={min(4, core.count('.'))}", f"-={min(4, core.count('-'))}", f"a={any(c.isalpha() for c in core)}", f"+={core.startswith('+')}", f"(={core.startswith('(')}", f"c={any(c in ':/%#' for c in core)}", f"l={check}",
    )


NONE = ("edge",)


@dataclass
class Crf:
    own: dict[str, np.ndarray]
    before: dict[str, np.ndarray]
    after: dict[str, np.ndarray]
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, tokens: list[str], known: dict[str, tuple[str, ...]] | None = None) -> np.ndarray:
        """known: shapes of short tokens seen before, fewer than 50,000."""
        known = {} if known is None else known
        if len(known) > 50_000:
            known.clear()
        for t in tokens:
            if len(t) <= 64 and t not in known:
                known[t] = shape(t)
        forms = [NONE, *(known.get(t) or shape(t) for t in tokens), NONE]
        return np.array([_sum(self.own, forms[k]) + _sum(self.before, forms[k - 1]) + _sum(self.after, forms[k + 1]) for k in range(1, len(forms) - 1)])


def _sum(table: dict[str, np.ndarray], features: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(TAGS))
    for f in features:
        if (w := table.get(f)) is not None:
            out = out + w
    return out


def labelled(row: str) -> tuple[list[str], list[int]]:
    """Tokens and tag numbers of a row of the table."""
    spans, text = [], ""
    at = 0
    for m in re.finditer(r"\[(" + "|".join(KINDS) + r"):([^\]]*)\]", row):
        text += row[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
        text += m[2]
        at = m.end()
    text += row[at:]
    tokens, tags, last = [], [], None
    for m in TOKEN.finditer(text):
        own = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
        tokens.append(m[0])
        tags.append(0 if own is None else 1 + 2 * own[2] + (own is last))
        last = own
    return tokens, tags


def allowed() -> np.ndarray:
    """A tag I-k follows B-k or I-k only."""
    n = len(TAGS)
    out = np.zeros((n, n))
    for b in range(2, n, 2):
        out[:, b] = -1e4
        out[b - 1, b] = out[b, b] = 0
    return out


def train(rows=LABELLED, steps: int = 200, rate: float = 0.1, l2: float = 2e-3) -> Crf:
    """Maximum likelihood by forward and backward sums over the padded table, with Adam."""
    data = [labelled(r) for r in rows]
    n, length, tags = len(data), max(len(t) for t, _ in data), len(TAGS)
    names = [sorted({f for t, _ in data for x in t for f in shape(x)} | set(NONE))] * 3
    number = [{f: i for i, f in enumerate(x)} for x in names]
    mask, gold = np.zeros((n, length), bool), np.zeros((n, length), int)
    width = max(len(shape(x)) for t, _ in data for x in t)
    feats = np.zeros((3, n, length, width), int) - 1
    for r, (t, y) in enumerate(data):
        forms = [NONE, *map(shape, t), NONE]
        for k in range(len(t)):
            mask[r, k], gold[r, k] = True, y[k]
            for j, f in enumerate((forms[k + 1], forms[k], forms[k + 2])):
                feats[j, r, k, : len(f)] = [number[j][x] for x in f]
    sizes = [len(x) for x in names]
    w = [np.zeros((s + 1, tags)) for s in sizes] + [np.zeros((tags, tags)), np.zeros((1, tags))]  # the last row of features stays 0
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    fixed, first = allowed(), np.where(np.arange(tags) % 2 + (np.arange(tags) == 0), 0, -1e4)
    one = np.eye(tags)
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for t in range(1, steps + 1):
        e = sum(w[j][feats[j]].sum(2) for j in range(3))
        moves, start = w[3] + fixed, w[4][0] + first
        alpha, beta = np.zeros((n, length, tags)), np.zeros((n, length, tags))
        alpha[:, 0] = start + e[:, 0]
        for k in range(1, length):
            alpha[:, k] = np.where(mask[:, k, None], lse(alpha[:, k - 1, :, None] + moves, 1) + e[:, k], alpha[:, k - 1])
        total = lse(alpha[:, -1], 1)
        for k in range(length - 2, -1, -1):
            beta[:, k] = np.where(mask[:, k + 1, None], lse(moves + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0)
        node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        d = node - one[gold] * mask[..., None]
        grad = []
        for j in range(3):
            g = np.zeros_like(w[j])
            np.add.at(g, feats[j], np.broadcast_to(d[:, :, None, :], (*feats[j].shape, tags)))
            g[-1] = 0
            grad.append(g)
        pair = np.zeros((tags, tags))
        for k in range(1, length):
            on = mask[:, k]
            pair += np.exp(alpha[on, k - 1, :, None] + moves + (e[on, k] + beta[on, k])[:, None, :] - total[on, None, None]).sum(0)
            np.add.at(pair, (gold[on, k - 1], gold[on, k]), -1)
        grad += [pair, d[:, 0].sum(0, keepdims=True)]
        for j, g in enumerate(grad):
            g = g / n + l2 * w[j]
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g**2
            w[j] = w[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    tables = [{f: w[j][i] for f, i in number[j].items()} for j in range(3)]
    return Crf(*tables, w[3] + fixed, w[4][0] + first)


def viterbi(crf: Crf, rows: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each sequence of emissions; sequences of like length go together."""
    out: list[np.ndarray] = [np.empty(0, int)] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    for low in range(0, len(order), 512):
        ids = order[low : low + 512]
        n, length = len(ids), len(rows[ids[-1]])
        e, mask = np.zeros((n, length, len(TAGS))), np.zeros((n, length), bool)
        for r, i in enumerate(ids):
            e[r, : len(rows[i])], mask[r, : len(rows[i])] = rows[i], True
        best, back = crf.start + e[:, 0], np.zeros((n, length, len(TAGS)), np.int8)
        for k in range(1, length):
            step = best[:, :, None] + crf.moves
            back[:, k] = np.where(mask[:, k, None], step.argmax(1), np.arange(len(TAGS)))
            best = np.where(mask[:, k, None], step.max(1) + e[:, k], best)
        tag = best.argmax(1)
        path = np.zeros((n, length), int)
        for k in range(length - 1, -1, -1):
            path[:, k] = tag
            tag = back[np.arange(n), k, tag]
        for r, i in enumerate(ids):
            out[i] = path[r, : len(rows[i])]
    return out


def windows(text: str, around: int = 2) -> list[list[re.Match]]:
    """Runs of tokens around those with a digit or an @."""
    if not TRIGGER.search(text):
        return []
    out: list[list[re.Match]] = []
    for line in re.finditer(r"[^\n]+", text):
        if not TRIGGER.search(line[0]):
            continue
        tokens = list(TOKEN.finditer(text, line.start(), line.end()))
        last = -1
        for k, t in enumerate(tokens):
            if TRIGGER.search(t[0]):
                low, high = max(k - around, last + 1), min(k + around + 1, len(tokens))
                if out and last >= 0 and low == last + 1 and k - around <= last + 1:
                    out[-1].extend(tokens[low:high])
                else:
                    out.append(tokens[low:high])
                last = high - 1
    return out


def parted(text: str, kind: int, run: list[re.Match]) -> list[tuple[int, int]]:
    """The spans of a run of tokens of one kind: a new one begins where the tokens so far are whole and the next would
    make them more than one of that kind."""
    digits = lambda low, high: len(DIGITS.findall(text, low, high))
    out, low, high = [], run[0].start(), run[0].end()
    for m in run[1:]:
        have, more = digits(low, high), digits(m.start(), m.end())
        if KINDS[kind] == "card":
            new = have >= 13 and (have + more > 19 or more >= 13)
        elif KINDS[kind] == "phone":
            new = have >= 7 and (have + more > 15 or m[0][0] in "(+")
        elif KINDS[kind] == "ip":
            new = text.count(".", low, high) >= 3
        else:
            new = "@" in text[low:high] and "@" in m[0]
        if new:
            out.append((low, high))
            low = m.start()
        high = m.end()
    return [*out, (low, high)]


def added_spans(texts: list[str], base: list[list[Span]], crf: Crf, known: dict | None = None) -> list[list[Span]]:
    """For each text the random field's spans that touch no base span."""
    owner, found = [], []
    for i, t in enumerate(texts):
        for w in windows(t):
            owner.append(i)
            found.append(w)
    known = {} if known is None else known
    out: list[list[Span]] = [[] for _ in texts]
    for i, w, tags in zip(owner, found, viterbi(crf, [crf.emissions([m[0] for m in w], known) for w in found])):
        k = 0
        while k < len(tags):
            if tags[k] == 0:
                k += 1
                continue
            j = k + 1
            while j < len(tags) and tags[j] == tags[k] + 1:
                j += 1
            text, kind = texts[i], (int(tags[k]) - 1) // 2
            for low, high in parted(text, kind, w[k:j]):
                m = EDGE_L.match(text[low:high])
                low += m.end() if m else 0
                m = EDGE_R.search(text[low:high])
                high = low + m.start() if m else high
                if high > low and TRIGGER.search(text[low:high]) and not any(a < high and low < b for _, a, b in base[i]):
                    out[i].append((kind, low, high))
            k = j
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, crf: Crf | None = None, piece: int = 2_000_000) -> DataFrame:
    """doc_id, base counts by kind (n_email, n_ip, n_card, n_phone), base_sha256, spans (base and added) and
    n_added for each row. Texts are worked off in pieces of about ``piece`` characters."""
    crf = crf or train()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            ids, texts = b["doc_id"].tolist(), [t or "" for t in b["text"]]
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= piece):
                    size += len(texts[high])
                    high += 1
                part = texts[low:high]
                base = [base_spans(t) for t in part]
                more = added_spans(part, base, crf, known)
                rows = []
                for x, y in zip(base, more):
                    n = [sum(s[0] == k for s in x) for k in range(4)]
                    rows.append((*n, hashlib.sha256(joined(x).encode()).hexdigest(), joined(x + y), len(y)))
                out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"], dtype=object)
                out.insert(0, "doc_id", pd.array(ids[low:high], dtype="Int64") if any(i != i or i is None for i in ids[low:high]) else ids[low:high])
                yield out
                low = high

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInPandas(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
