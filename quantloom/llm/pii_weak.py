"""Personal data: exact base patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and checks.  Further candidates outside of them are secrets
(long tokens with digits), passwords, ids (grouped numbers, account numbers), addresses and names.
Each gets votes of five labelers, by kind: its form, gazetteers, the context around it, and two of shape (entropy and
mixture of character classes for secrets and ids, place in the sentence and length for addresses and names).
Expectation maximisation over the votes of all documents estimates how reliable each labeler is for each kind; its
posteriors train a logistic span classifier of the kind, which then decides on every candidate.

At scale: one pass over the texts writes spans and candidates; what EM and the classifiers learn from is the histogram of
vote patterns by kind, length and digit share, at most 5 * CELLS rows whatever the corpus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, small_batches

KINDS = ("email", "ip", "card", "phone", "secret", "password", "id", "address", "name")
ADDED = KINDS[4:]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always takes whole digit runs, so possessive runs and a look-behind change nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in linear time: from each @, back over the local part."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    d = [int(x) for x in digits[::-1]]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind."""
    out = [("email", *x) for x in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- labelers: 2 for, 1 against, 0 no opinion
LABELERS = 5
LENGTH_BINS = (12, 16, 20, 28, 36, 48)
DIGIT_BINS = (0.15, 0.35, 0.6, 0.95)
CELLS = 3**LABELERS * (len(LENGTH_BINS) + 1) * (len(DIGIT_BINS) + 1)
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/.-]{8,}")
_FORM = re.compile(r"[A-Z]{4}[A-Z0-9]{16}|(?:[0-9a-f]{16,}|[0-9A-F]{16,})|(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9_-]{10,}")
_NUMBERED_NAME = re.compile(r"[A-Za-z]*(?:[-._/][0-9]+)+")
_CREDENTIAL = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|auth|bearer|login|pin)\b", re.I)
_PLAIN = re.compile(r"(?:https?|www|page|version|chapter|isbn|figure|year|file|doi)\b", re.I)
_OPERATOR = re.compile(r"[:=]\s*[\"']?$")
_PROSE = re.compile(r"[a-z,.]\s$")


_PASSWORD = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|wort)|pwd|contraseña|mot de passe|kennwort)\s{0,3}(?:[:=]|is|ist|est|es)\s{0,3}[\"']?([^\s\"',;]{6,64})")
_ID = re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{1,2} ?[0-9]{6,9}|[0-9]{2,4}(?: [0-9]{2,4}){2,4})(?![\w-])")
_ADDRESS = re.compile(
    r"(?<!\w)(?:[0-9]{1,5}[a-z]?,? (?:[A-ZÀ-Þ][a-zß-ÿ]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)"
    r"|[A-ZÄÖÜ][a-zäöüß]{1,20}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?"
    r"|[0-9]{1,4},? (?:rue|avenue|boulevard|place|allée) (?:(?:de|du|des|la|le|les) ){0,2}[A-ZÀ-Þ][a-zß-ÿ-]{1,20}"
    r"|(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|las|los) ){0,2}[A-ZÀ-Þ][a-zß-ÿ]{1,20},? [0-9]{1,4})(?!\w)"
)
_NAME = re.compile(r"(?<![\w'-])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}(?: (?:(?:van|von|de|del|la|der) ){0,2}(?:[A-Z]\.|[A-ZÀ-ÖØ-Þ](?:'[A-Z])?[a-zß-öø-ÿ-]{1,20})){0,3}(?![\w'])")
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme)\.?|\b(?:Miss|Herr|Herrn|Frau|Señor|Señora|Monsieur|Madame|Mister|Doctor|Professor)) $")
_NAMED = re.compile(r"(?i)(?:\b(?:name(?:d| is|:)?|called|contact:?|signed(?: by)?|author:?|patient:?|customer:?|heißt|heiße|nombre:?|llamo|llama|nom:?|m'appelle|s'appelle|dear|sincerely,?|regards,?)) $")
_LIVES = re.compile(r"(?i)\b(?:address:?|lives? (?:at|in)|living at|ship(?:ped)? to:?|resid\w+ (?:at|in)|home:?|wohnt (?:in|an)(?: der)?|adresse:?|anschrift:?|habite(?: au)?|dirección:?|vive en(?: la)?|domicilio:?) $")
_NUMBERED = re.compile(r"(?i)\b(?:ssn|social security(?: number| no\.?)?|passport(?: number| no\.?)?|iban|account(?: number| no\.?)?|id(?: number| no\.?)?|licen[cs]e(?: number| no\.?)?|tax(?: id| number)?|ausweis(?:nummer)?|steuer-?id|dni|nif|numéro|reisepass|pasaporte|passeport)(?: is| ist| es| est)?[:#]? $")
_NOT_NUMBERED = re.compile(r"(?i)\b(?:page|pages|years?|table|figure|chapter|line|lines|version|score|results?|of|and|from|to|between|isbn|order|invoice|model) $")
#: Gazetteers of the labelers: given names; words that begin with a capital and are no names.
GIVEN_NAMES = frozenset(
    "Adam Alan Alice Amy Andrea Andrew Angela Ann Anna Anne Antonio Barbara Ben Brian Carlos Carmen Carol Charles Chris Christine Claire Daniel David Deborah Dennis Donna Edward Elena Elizabeth Emily Emma Eric "
    "Eva Francisco Frank George Hans Heather Helen Henry Isabel Jack James Jane Javier Jean Jennifer Jessica Joan John Jorge José Joseph Juan Julia Julie Karen Karl Kate Kevin Klaus Laura Lisa Louis Lucas "
    "Lucía Luis Manuel Marc Margaret Maria María Marie Mark Martin Mary Matthew Michael Michelle Miguel Monika Nancy Nicolas Olivia Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Rachel Richard Robert "
    "Rosa Ruth Samuel Sandra Sarah Sophie Stefan Stephen Steven Susan Thomas Ursula Victor William Wolfgang".split()
)
TITLES = frozenset("Mr Mrs Ms Dr Prof Sr Sra Mme Miss Herr Herrn Frau Señor Señora Monsieur Madame Mister Doctor Professor Dear".split())
NO_NAMES = frozenset(
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December The This That These Those There Here And But For With From "
    "When Where What Who Why How Street Avenue Road Park River Lake University College School Company Bank Hotel Museum Street North South East West New Saint Chapter Figure Table Page Section Version".split()
)


#: What is said of passwords.
NO_PASSWORDS = frozenset("required incorrect expired invalid changed protected needed missing wrong correct stored encrypted hashed optional secret unknown".split())


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def votes(text: str, start: int, end: int) -> tuple[int, ...]:
    token, before = text[start:end], text[max(0, start - 24) : start]
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    form = 2 if _FORM.fullmatch(token) and digits and letters else 1 if not letters or token.count(".") > 1 or _NUMBERED_NAME.fullmatch(token) else 0
    gazetteer = 2 if _CREDENTIAL.search(before) else 1 if _PLAIN.search(before) or "/" in token else 0
    context = 2 if _OPERATOR.search(before) else 1 if _PROSE.search(before) else 0
    h = entropy(token)
    chaos = 2 if h >= 3.0 and len(token) >= 14 else 1 if h < 2.5 else 0
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    mixture = 2 if turns >= 4 else 1 if turns <= 1 else 0
    return form, gazetteer, context, chaos, mixture


def account_checks(token: str) -> bool:
    """The remainder test of international account numbers."""
    t = token.replace(" ", "")
    return 15 <= len(t) <= 34 and t[:2].isalpha() and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def id_votes(text: str, start: int, end: int) -> tuple[int, ...]:
    token, before = text[start:end], text[max(0, start - 40) : start]
    grouped = len(token) == 11 and token[3] == token[6] == "-"
    form = 2 if grouped and token[:3] not in ("000", "666") and token[0] != "9" and token[4:6] != "00" or account_checks(token) else 1 if token.replace(" ", "").isdigit() else 0
    gazetteer = 2 if _NUMBERED.search(before) else 1 if _NOT_NUMBERED.search(before) else 0
    context = 2 if _OPERATOR.search(before) or before[-2:] in (": ", "# ") else 1 if _PROSE.search(before) and not _NUMBERED.search(before) else 0
    digits = sum(c.isdigit() for c in token)
    return form, gazetteer, context, 2 if digits >= 8 else 1 if digits < 7 else 0, 2 if grouped or token[0].isalpha() else 1


def address_votes(text: str, start: int, end: int) -> tuple[int, ...]:
    token, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
    form = 2 if re.match(r",? (?:[A-Z]{2} )?[0-9]{4,5}\b|,? [A-ZÀ-Þ][a-zß-ÿ]+,? [A-Z]{2} [0-9]{5}", after) else 0
    words = token.replace(",", "").split()
    gazetteer = 1 if NO_NAMES & set(words[1:-1]) or re.match(r" (?:Books?|Journal|Band|Films?|station|bridge)\b", after) else 2 if words[-1] in ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard") or not token[0].isdigit() else 0
    context = 2 if _LIVES.search(before) else 1 if re.search(r"(?i)\b(?:page|chapter|in|since|year|of|figure|route) $", before) else 0
    number = re.search(r"[0-9]+", token)
    place = 1 if number and 1500 <= int(number[0]) <= 2100 and token[0].isdigit() else 2
    return form, gazetteer, context, place, 2 if 2 <= len(words) <= 5 else 1


def name_votes(text: str, start: int, end: int) -> tuple[int, ...]:
    token, before = text[start:end], text[max(0, start - 24) : start]
    words = token.split()
    form = 2 if 2 <= len(words) <= 4 else 0
    gazetteer = 1 if NO_NAMES & set(words) else 2 if words[0] in GIVEN_NAMES else 0
    context = 2 if _TITLE.search(before) or _NAMED.search(before) else 0
    inside = re.search(r"[a-zß-ÿ,] $", before)
    return form, gazetteer, context, 2 if inside else 1 if not before or re.search(r"[.!?\n]\s*$", before) else 0, 1 if len(words) == 1 and context != 2 else 2 if len(words) > 1 else 0


def password_votes(text: str, start: int, end: int) -> tuple[int, ...]:
    token, before = text[start:end].rstrip(".!?"), text[max(0, start - 24) : start]
    mixed = sum(any(f(c) for c in token) for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum()))
    form = 2 if mixed > 1 else 0
    gazetteer = 1 if token.lower() in NO_PASSWORDS else 0
    context = 2 if _OPERATOR.search(before) else 0
    return form, gazetteer, context, 2 if entropy(token) >= 2.8 and token.lower() not in NO_PASSWORDS else 1, 2 if len(token) >= 8 else 0


VOTES = {"secret": votes, "password": password_votes, "id": id_votes, "address": address_votes, "name": name_votes}


def cell(text: str, start: int, end: int, kind: str = "secret") -> int:
    """The candidate's kind, votes and features as one number below 5 * CELLS."""
    code = ADDED.index(kind)
    for v in VOTES[kind](text, start, end):
        code = code * 3 + v
    token = text[start:end]
    share = sum(c.isdigit() for c in token) / len(token)
    code = code * (len(LENGTH_BINS) + 1) + sum(len(token) >= x for x in LENGTH_BINS)
    return code * (len(DIGIT_BINS) + 1) + sum(share >= x for x in DIGIT_BINS)


def _found(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what may be personal data, the kinds that win an overlap first."""
    digits = bool(_DIGIT.search(text))
    for m in _PASSWORD.finditer(text):
        if len(m[1]) < 8 or not _DIGIT.search(m[1]):  # others are secrets
            yield "password", m.start(1), m.end(1)
    if digits:
        for m in _ID.finditer(text):
            yield "id", m.start(), m.end()
        for m in _ADDRESS.finditer(text):
            yield "address", m.start(), m.end()
        for m in _CANDIDATE.finditer(text):
            start, end = m.start(), m.end()
            while end > start and text[end - 1] in ".-/+_":
                end -= 1
            if end - start >= 8 and _DIGIT.search(text, start, end):
                yield "secret", start, end
    for m in _NAME.finditer(text):
        start, words = m.start(), m[0].split()
        while words and words[0] in TITLES:  # belongs to what comes before the name
            start += len(words.pop(0)) + 1
        before = text[max(0, start - 24) : start]
        if words and (words[0] in GIVEN_NAMES or _TITLE.search(before) or _NAMED.search(before)):
            yield "name", start, m.end()


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, cell) of the candidates outside the spans taken, none in another one, by start."""
    spans = sorted((s, e) for _, s, e in taken)
    out = []
    for kind, start, end in _found(text):
        k = bisect_left(spans, (start, start))
        if k and spans[k - 1][1] > start or k < len(spans) and spans[k][0] < end:
            continue
        insort(spans, (start, end))
        out.append((start, end, cell(text, start, end, kind)))
    return sorted(out)


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, digits = np.divmod(codes, len(DIGIT_BINS) + 1)
    codes, length = np.divmod(codes, len(LENGTH_BINS) + 1)
    v = np.stack([codes // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)], axis=1)
    return v, length, digits


def posteriors(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(probability of personal data, reliability table (class, labeler, vote)) by EM over vote patterns with counts n."""
    for_, against = (v == 2).sum(axis=1), (v == 1).sum(axis=1)
    p = np.where(for_ > against, 0.9, np.where(for_ < against, 0.1, 0.5))
    table = np.full((2, LABELERS, 3), 1 / 3)
    for _ in range(rounds):
        for c, w in enumerate((n * (1 - p), n * p)):
            for k in range(LABELERS):
                # a labeler is taken to be right rather than wrong until the data say otherwise
                table[c, k] = np.bincount(v[:, k], weights=w, minlength=3) + (2, 1 + 3 * (c == 0), 1 + 3 * (c == 1))
                table[c, k] /= table[c, k].sum()
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        like = [np.log(table[c][np.arange(LABELERS), v]).sum(axis=1) for c in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1] + math.log((1 - prior) / prior), -500, 500)))
    return p, table


def fit_kinds(codes: np.ndarray, n: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """For each cell of each kind whether the kind's classifier accepts it."""
    kind = codes // CELLS
    return np.concatenate([fit(codes[kind == k] % CELLS, n[kind == k], threshold) for k in range(len(ADDED))])


def fit(codes: np.ndarray, n: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """For each of CELLS cells whether the span classifier accepts it; learned from cells seen n times."""
    accept = np.zeros(CELLS, bool)
    if not len(codes):
        return accept

    def design(c: np.ndarray) -> np.ndarray:
        v, length, digits = _unpack(c)
        parts = [np.eye(3)[v[:, k]] for k in range(LABELERS)]
        return np.hstack([*parts, np.eye(len(LENGTH_BINS) + 1)[length], np.eye(len(DIGIT_BINS) + 1)[digits], np.ones((len(c), 1))])

    p, _ = posteriors(_unpack(codes)[0], n.astype(float))
    x, w = design(codes), n / n.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (q - p)) + 1e-4 * beta
        hess = (x * (w * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(beta))
        beta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    all_ = np.arange(CELLS)
    return design(all_) @ beta > math.log(threshold / (1 - threshold))


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """A row per row of docs: doc_id, base and added (arrays of (kind, start, end), by start and kind).

    Offsets are code points, the end exclusive.  Null and empty texts have no spans; texts of any length are read whole.
    `added` never overlaps `base`; of candidates that overlap one stays, passwords before ids, addresses, other secrets
    and names, then the first.  Without candidates nothing is added; an empty table gives no rows.  Repeated rows get
    equal spans, and count as often as they are there; other columns of docs play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    span = "array<struct<kind:string,start:long,end:long>>"
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for t in batch.column(0).to_pylist():
                b = base_spans(t) if t else []
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in b])
                more.append([{"start": s, "end": e, "cell": c} for s, e, c in (candidates(t, b) if t else ())])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(base, kinds), pa.array(more, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cell", pa.int32())])))], names=["doc_id", "base", "more"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    scanned = materialize(rows.mapInArrow(scan, f"doc_id long, base {span}, more array<struct<start:long,end:long,cell:int>>"))
    cells = scanned.select(F.explode("more.cell").alias("cell")).groupBy("cell").count().orderBy("cell").toArrow()
    accept = fit_kinds(cells["cell"].to_numpy().astype(np.int64), cells["count"].to_numpy(), threshold)
    good = [int(c) for c in np.flatnonzero(accept)[np.isin(np.flatnonzero(accept), cells["cell"].to_numpy())]]
    chosen = F.filter("more", lambda x: x["cell"].isin(good)) if good else F.filter("more", lambda x: F.lit(False))
    name = F.array(*[F.lit(k) for k in ADDED])
    added = F.transform(chosen, lambda x: F.struct(F.get(name, F.floor(x["cell"] / CELLS).cast("int")).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return scanned.select("doc_id", "base", added.cast(span).alias("added"))


def joined_spans(column: str):
    """kind:start:end by start and kind, comma-joined."""
    order = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    keyed = F.transform(column, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
