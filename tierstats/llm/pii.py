"""Personal data: labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Base kinds first, then the method's, in the order in which spans of one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_spelled", "card_part", "phone_part", "phone_local", "ssn", "iban", "secret", "name")

# An email's local part is the run of its characters before "@"; looking for the "@" first keeps long runs linear.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, DIGITS, HEX = re.compile(r"[0-9]"), re.compile(r"[0-9]+"), re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
ASSIGNED = re.compile(r"[=:] *[\"']?$")

AT = re.compile(r" ?[\[(] ?at ?[\])] ?", re.I)
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++)+", re.I)
#: A phone number at the head of a run of digits that is too long for one.
PHONE_HEAD = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![\w+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
#: At most 34 characters, as the standard says.
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Not the head of a host or an address, and no path (three slashes or more).
SECRET = re.compile(r"(?<![A-Za-z0-9+/_.@=-])(?!(?:[A-Za-z0-9+_-]*+/){3})(?=[0-9+/_-]*+[A-Za-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+_=-]*+[/.@][A-Za-z0-9])")
#: Formats that only secrets have (fixed values).
SECRET_HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ")
HEX_SIZES = frozenset((32, 40, 48, 64, 96, 128))
#: Gazetteers and cue words (fixed values).
GIVEN_NAMES = (
    "Alice Andrea Andrew Anna Anthony Barbara Carlos Carmen Charles Christopher Claire Claudia Daniel David Deborah Elizabeth Emily "
    "Emma Francisco François George Hannah Heinrich Helen Isabel James Jennifer Jessica John José Joseph Juan Julia Karen Katharina "
    "Laura Linda Lucía Margaret Maria Marie Martin Mary Michael Michelle Miguel Nicole Olivia Patricia Paul Peter Pierre Rachel "
    "Richard Robert Sandra Sarah Sophie Stefan Stephen Steven Susan Thomas William Wolfgang"
).split()
TITLES = "Mr Mrs Ms Dr Herr Frau Señor Señora Monsieur Madame Signed Dear".split()
_CAPITAL = r"[A-ZÀ-Þ][a-zß-ÿ]+"
NAME = re.compile(rf"(?<!\w)(?:{'|'.join(GIVEN_NAMES)})(?: [A-Z]\.)?(?: {_CAPITAL}){{1,2}}(?!\w)")
TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?:? ({_CAPITAL}(?: [A-Z]\.)?(?: {_CAPITAL}){{1,2}})(?!\w)")
CUES = {
    "email": "email e-mail mail contact write reach address",
    "ip": "ip host server address login client",
    "card": "card visa mastercard credit debit payment pay account",
    "phone": "phone tel telephone call mobile cell fax contact",
    "ssn": "ssn social security",
    "iban": "iban account bank transfer",
    "secret": "token secret password passwd pwd key apikey api bearer auth authorization credential credentials access private",
    "name": "mr mrs ms dr name signed dear contact by from herr frau señor señora monsieur madame",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
CUES |= {"email_spelled": CUES["email"], "phone_local": CUES["phone"], "phone_part": CUES["phone"], "card_part": CUES["card"]}
AGAINST = frozenset("version isbn issn order invoice serial part model build release section chapter figure table page id hash commit".split())
AGAINST_SECRET = frozenset("sha sha1 sha256 sha512 md5 hash commit checksum digest revision uuid guid etag version".split())
TLDS = frozenset("com org net edu gov io de fr es uk eu info biz co us me dev app".split())
WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
#: Regex labelers (shape, edges), a gazetteer labeler and context labelers (cue, against).
LABELERS = ("shape", "gazetteer", "cue", "against", "edges")
#: Classes of a span's length, share of digits, letters' case and preceding word, which the classifier sees besides the votes.
CLASSES = (8, 4, 4, 16)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost non-overlapping matches of each kind; failing ones are dropped."""
    out = []
    if "@" in text:
        done = 0
        for m in EMAIL.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            done = m.end()
            out.append((start, done, "email"))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Cover:
    """Merged spans, so that an overlap is found by bisection."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.add(spans)

    def add(self, spans: list[tuple[int, int, str]]) -> None:
        both, self.starts, self.ends = sorted([*zip(self.starts, self.ends, strict=True), *((s, e) for s, e, _ in spans)]), [], []
        for s, e in both:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        at = bisect_left(self.starts, e) - 1
        return at >= 0 and self.ends[at] > s


def spelled_emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in AT.finditer(text):
        domain, start = SPELLED_DOMAIN.match(text, m.end()), m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if domain and start < m.start():
            done = domain.end()
            yield start, done


def card_parts(text: str) -> Iterator[tuple[int, int]]:
    """Runs of groups of three or more digits that make a card number where the whole run of digits does not."""
    for m in CARD.finditer(text):
        whole = m.group().replace(" ", "").replace("-", "")
        if len(whole) < 14 or 14 <= len(whole) <= 19 and luhn(whole):
            continue
        groups = [(g.start(), g.end(), g.group()) for g in DIGITS.finditer(text, *m.span())]
        i = 0
        while i < len(groups):
            digits, j, found = "", i, 0
            while j < len(groups) and len(groups[j][2]) >= 3 and len(digits) + len(groups[j][2]) <= 19:
                digits += groups[j][2]
                j += 1
                if len(digits) >= 14 and luhn(digits):
                    found = j
                    yield groups[i][0], groups[j - 1][1]
                    break
            i = found or i + 1


def names(text: str) -> Iterator[tuple[int, int]]:
    found = {m.span() for m in NAME.finditer(text)}
    found |= {m.span(1) for m in TITLED.finditer(text)}
    return iter(sorted(found))


def more_candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates of the method's own kinds that overlap no span of an earlier kind."""
    finders: list[tuple[str, Callable[[str], Iterator[tuple[int, int]]]]] = []
    if AT.search(text):
        finders.append(("email_spelled", spelled_emails))
    if DIGIT.search(text):
        finders.append(("card_part", card_parts))
        if "+" in text:
            finders.append(("phone_part", lambda t: (m.span() for m in PHONE_HEAD.finditer(t))))
        finders += [(k, lambda t, p=p: (m.span() for m in p.finditer(t))) for k, p in (("iban", IBAN), ("ssn", SSN), ("phone_local", LOCAL_PHONE), ("secret", SECRET))]
    if any(n in text for n in GIVEN_NAMES) or any(n in text for n in TITLES):
        finders.append(("name", names))
    out: list[tuple[int, int, str]] = []
    busy = Cover(taken)
    for kind, find in finders:
        new, last = [], 0
        for s, e in find(text):
            if s >= last and not busy.meets(s, e):
                new.append((s, e, kind))
                last = e
        out += new
        busy.add(new)
    return out


def votes(text: str, s: int, e: int, kind: str) -> str:
    """One of "+", "-", "0" for each labeler, then the classes."""
    span = text[s:e]
    near = [w.lower() for w in WORD.findall(text[max(0, s - 60) : s])][-5:]
    digits = sum(c.isdigit() for c in span)
    shape, gazetteer = "+", "0"
    if kind == "ssn":
        shape = "+" if span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000" else "-"
    elif kind == "iban":
        plain = span.replace(" ", "")
        shape = "+" if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else "-"
    elif kind in ("card", "card_part"):
        shape = "+" if span[0] in "3456" else "-"
        gazetteer = "+" if span[:1] == "4" or span[:2] in ("34", "37", "51", "52", "53", "54", "55") else "0"
    elif kind in ("email", "email_spelled"):
        gazetteer = "+" if re.split(r"[^A-Za-z]+", span)[-1].lower() in TLDS else "-"
    elif kind == "secret":
        plain = span.rstrip("=")
        shape = "+" if HEX.fullmatch(plain) and len(plain) in HEX_SIZES or len(set(plain)) >= 16 else "-" if len(set(plain)) < 8 else "0"
        gazetteer = "+" if span.startswith(SECRET_HEADS) else "-" if UUID.fullmatch(span) else "0"
    elif kind == "name":
        parts = span.split()
        shape = "-" if len(set(parts)) < len(parts) else "+"
        gazetteer = "+" if parts[0] in GIVEN_NAMES else "0"
    elif kind in ("phone", "phone_part"):
        shape = "-" if "  " in span or ".." in span or span.count("(") != span.count(")") else "+"
    elif kind == "ip":
        shape = "-" if span[:2] == "0." or span.count("0") == 4 else "+"
        gazetteer = "-" if near and near[-1] in ("version", "v", "release") else "0"
    cue = "+" if CUES[kind] & set(near) else "0"
    against = "-" if (AGAINST_SECRET if kind == "secret" else AGAINST) & set(near[-2:]) or kind != "secret" and text[max(0, s - 1) : s] in ("#", "=", "/", "_") else "0"
    left, right = text[s - 1] if s else " ", text[e] if e < len(text) else " "
    edges = "-" if left.isalnum() or right.isalnum() else "+"
    if kind == "secret" and edges == "+":
        edges = "+" if ASSIGNED.search(text[max(0, s - 8) : s]) else "0"
    case = (any(c.isupper() for c in span)) + 2 * (any(c.islower() for c in span))
    word = crc32(near[-1].encode()) % 15 + 1 if near else 0
    return f"{shape}{gazetteer}{cue}{against}{edges}{min(7, (e - s) // 4):x}{min(3, 4 * digits // (e - s)):x}{case:x}{word:x}"


CAND = "array<struct<kind:string,start:int,end:int,pattern:string>>"
_CAND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for t in b.column(1):
            text = t.as_py() or ""
            base = base_spans(text)
            found.append([{"kind": k, "start": s, "end": e, "pattern": votes(text, s, e, k)} for s, e, k in base + more_candidates(text, base)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _CAND)], names=["id", "spans"])


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 50, shared: float = 10.0) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """Expectation-maximisation over (kind, pattern, count), with one hidden class, private or not.

    Returns P(vote | class) of each kind as [kind, labeler, class, vote] (kinds in order of name), the share of private
    spans by kind, and each pattern's posterior. It starts from the majority vote. The labelers' rates over all kinds
    count as ``shared`` further votes for each kind, so that a kind with few spans has sane ones, and every count has one
    added, so no vote is ever impossible.
    """
    v = np.array([["-0+".index(c) for c in p[: len(LABELERS)]] for _, p, _ in patterns])
    n = np.array([c for *_, c in patterns], float)
    kinds = sorted({k for k, *_ in patterns})
    kind = np.array([kinds.index(k) for k, *_ in patterns])
    post = 1 / (1 + np.exp(1.0 - 2.0 * (v - 1).sum(axis=1)))  # a tie leans to not private
    labs = np.arange(len(LABELERS))
    for _ in range(rounds):
        counts = np.zeros((len(kinds), len(LABELERS), 2, 3))
        for c, w in enumerate((n * (1 - post), n * post)):
            for lab in labs:
                np.add.at(counts[:, lab, c], (kind, v[:, lab]), w)
        pooled = counts.sum(axis=0) + 1
        pooled /= pooled.sum(axis=2, keepdims=True)
        p = counts + shared * pooled
        p /= p.sum(axis=3, keepdims=True)
        prior = (np.bincount(kind, n * post, len(kinds)) + 1) / (np.bincount(kind, n, len(kinds)) + 2)
        score = np.log(prior / (1 - prior))[kind]
        for lab in labs:
            score = score + np.log(p[kind, lab, 1, v[:, lab]] / p[kind, lab, 0, v[:, lab]])
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p, dict(zip(kinds, prior.tolist(), strict=True)), post


def features(kind: str, pattern: str) -> list[int]:
    """Numbers of the active features: kind, each vote, each vote of this kind, each class."""
    k, votes_of, own = KINDS.index(kind), 3 * len(LABELERS), ["-0+".index(c) for c in pattern[: len(LABELERS)]]
    at = [k, *(len(KINDS) + 3 * i + c for i, c in enumerate(own)), *(len(KINDS) + votes_of * (1 + k) + 3 * i + c for i, c in enumerate(own))]
    base = len(KINDS) + votes_of * (1 + len(KINDS))
    for size, c in zip(CLASSES, pattern[len(LABELERS) :], strict=True):
        at.append(base + int(c, 16))
        base += size
    return at


N_FEATURES = len(KINDS) + 3 * len(LABELERS) * (1 + len(KINDS)) + sum(CLASSES)


def train_classifier(patterns: list[tuple[str, str, int]], steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on the posteriors, weighted by counts; the last weight is the bias."""
    if not patterns:
        return np.zeros(N_FEATURES + 1)
    _, _, target = reliabilities(patterns)
    x = np.zeros((len(patterns), N_FEATURES + 1))
    for i, (k, p, _) in enumerate(patterns):
        x[i, [*features(k, p), N_FEATURES]] = 1
    n = np.array([c for *_, c in patterns], float)
    w = np.zeros(N_FEATURES + 1)
    for _ in range(steps):  # Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (q - target)) + ridge * w
        hessian = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans), one row for each row of ``docs``.

    ``base`` and ``spans`` are arrays of (kind, start, end) in code points, ordered by start and kind; spans holds
    the base spans and those of the method's kinds that the classifier accepts. The texts are read once; what is
    gathered to the driver is the count of each vote pattern over all spans, at most kinds x 3^labelers x the product of
    CLASSES, however many documents there are; from it the labelers' reliabilities and the classifier are estimated.

    Null text is empty. Repeated rows and null ids keep a row each. Without any candidate, and for an empty table,
    the model is not used. Long texts are read whole, in linear time. Other columns are not carried, so their names
    cannot clash.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_extract, f"id {id_type}, spans {CAND}")
    found = staged(found, "pii")
    each = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern").agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted((r["kind"], r["pattern"], r["n"]) for r in each.collect())
    w = train_classifier(patterns)
    score = {(k, p): float(w[[*features(k, p), N_FEATURES]].sum()) for k, p, _ in patterns}
    bar = float(np.log(threshold / (1 - threshold)))
    accepted = sorted(f"{k}:{p}" for (k, p), s in score.items() if k not in BASE_KINDS and s >= bar)
    order = F.array(*(F.lit(k) for k in KINDS))
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["pattern"].alias("pattern"))))
    found = found.withColumn("all", ranked)
    is_base = lambda s: s["kind"].isin(*BASE_KINDS)
    keep = (lambda s: is_base(s) | F.concat_ws(":", s["kind"], s["pattern"]).isin(accepted)) if accepted else is_base
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias(id_col), *(count(k) for k in BASE_KINDS), plain(F.filter("all", is_base)).alias("base"), plain(F.filter("all", keep)).alias("spans"))


def joined(spans: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
