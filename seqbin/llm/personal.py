"""Personal data in texts, by weak supervision.

Candidates are the spans of four base kinds and those of wider patterns: addresses written
out, numbers without a country code, card-like numbers that fail their check, account and
identity numbers, names after a form of address. Nobody has labelled them. Six labelers
vote for, against, or not at all: the base patterns, check digits, gazetteers (top-level
domains, calling codes, issuers, countries, first names), cue words before the span, its
boundaries and its written form. Spark counts the vote patterns of each kind over all
documents; there are at most ``3 ** 6`` of them per kind, whatever the input, and
expectation-maximisation on these counts estimates how far each labeler can be trusted for
each kind (Dawid and Skene, with a prior that labelers beat chance).

The posteriors are the soft labels of a logistic regression over the surroundings, the
shape and the checks of all candidates, trained on Spark. Base spans always stay; a wider
candidate becomes a span if that classifier gives it 0.5 or more.

Defined cases: a null or empty text has no spans; without any candidate nothing is trained;
rows are told apart even if they repeat a doc_id, which may be null; long texts are scanned
whole, in time linear in their length; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbin.staging import stage

# fixed values: the base kinds, in the order in which they are listed, and the added ones
KINDS = ("email", "ip", "card", "phone", "account", "identity", "name")
EMAIL, IP, CARD, PHONE, ACCOUNT, IDENTITY, NAME = range(7)
BASE_KINDS = 4
FOR, AGAINST, SILENT = 0, 1, 2
LABELERS = ("pattern", "check", "gazetteer", "context", "boundary", "form")
#: hashed features of the classifier
FEATURES = 1 << 13

# --- base patterns -----------------------------------------------------------------

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a failing run of digits fails at each of its digits: it is tried once
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether a number passes the check of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each ``@`` all of the name before it, then the domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        # nothing before the last @ or the last match can belong to the name
        begin = at
        while begin > last:
            low = max(last, begin - 256)
            found = low + _LOCAL_END.search(text[low:begin]).start()
            begin, done = found, found > low
            if done:
                break
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        last = domain.end() if domain else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, by start and kind, in code points."""
    found = [(start, EMAIL, end) for start, end in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), PHONE, m.end()))
    found.sort()
    return found


# --- wider patterns ------------------------------------------------------------------

_AT = re.compile(r"\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?")
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"(?<![A-Za-z0-9+.,-])\(?[0-9][0-9\x20().-]{5,}[0-9](?![A-Za-z0-9])")
_IDENTITY = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(
    r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra|Don|Doña)\.?\x20([A-Z]\w+(?:\x20[A-Z]\w+)?)"
)


def _overlaps(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    """Whether a span meets one of some spans that do not meet each other, given in order."""
    at = bisect_right(starts, start)
    return (at > 0 and ends[at - 1] > start) or (at < len(starts) and starts[at] < end)


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of wider candidates; none meets a base span or another one."""
    found = []
    for m in _AT.finditer(text):
        domain = _SPELLED.match(text, m.end())
        # names of mailboxes have at most 64 characters
        name = _LOCAL_END.search(text[max(0, m.start() - 64) : m.start()]).group()
        written_out = m.group().strip() != "at" or (domain and "dot" in domain.group())
        if domain and name and written_out:
            found.append((m.start() - len(name), EMAIL, domain.end()))
    found += [(m.start(), ACCOUNT, m.end()) for m in _ACCOUNT.finditer(text)]
    for m in _NUMBER.finditer(text):
        digits = len(_NO_DIGIT.sub("", m.group()))
        if _IDENTITY.fullmatch(m.group()):
            found.append((m.start(), IDENTITY, m.end()))
        elif 14 <= digits <= 19:
            found.append((m.start(), CARD, m.end()))
        elif 7 <= digits <= 15:
            found.append((m.start(), PHONE, m.end()))
    found += [(m.start(1), NAME, m.end(1)) for m in _NAME.finditer(text)]
    out: list[tuple[int, int, int]] = []
    starts, ends = _merged(base)
    last = -1
    for start, kind, end in sorted(found):
        if start >= last and not _overlaps(starts, ends, start, end):
            out.append((start, kind, end))
            last = end
    return out


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that some spans, in order of start, cover."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


# --- labelers ------------------------------------------------------------------------

# fixed values: gazetteers
_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name io ai dev app me eu uk us ca au de fr es it nl be ch at pt br mx ar cl co"
    " pl cz se no dk fi ru ua tr gr ie in cn jp kr za".split()
)
_CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90"
    " 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 370 371 372 380 385 386 420 421".split()
)
_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split())
_FIRST_NAMES = frozenset(
    "James Mary John Anna Robert Linda Michael Sarah David Laura Peter Julia Thomas Maria Paul Emma Hans Petra Klaus"
    " Ursula Jürgen Monika Stefan Sabine Jean Marie Pierre Sophie Michel Claire Jacques Camille José Carmen Juan Lucía"
    " Carlos Elena Antonio Pilar".split()
)
_CUES = {
    EMAIL: "email e-mail mail mailto contact write correo courriel adresse",
    IP: "ip host server address client addr dirección",
    CARD: "card visa mastercard amex credit debit karte kreditkarte carte tarjeta payment",
    PHONE: "phone tel telephone call mobile fax cell telefon handy anruf téléphone appelez teléfono móvil llame",
    ACCOUNT: "iban account konto compte cuenta bank bic",
    IDENTITY: "ssn social security identity ausweis dni passport",
    NAME: "name signed regards named heißt nom nombre",
}
_CUES = {kind: frozenset(words.split()) for kind, words in _CUES.items()}
_AGAINST_CUES = frozenset(
    "version v order isbn issn page pages total id ref no nr number sku build release line size bytes doi part serial"
    " bestellung commande pedido seite página".split()
)
_WORDS = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_DATE = re.compile(r"(?:[0-9]{4}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ][0-9]{4})")
_ISSUED = re.compile(r"(?:4|5[1-5]|2[2-7]|3[0-9]|6)")


def _check(kind: int, value: str, digits: str) -> int:
    if kind == CARD:
        return FOR if luhn(digits) else AGAINST
    if kind == ACCOUNT:
        plain = value.replace(" ", "")
        return FOR if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else AGAINST
    if kind == IDENTITY:
        return AGAINST if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else FOR
    if kind == IP:
        return FOR if all(p == "0" or p[0] != "0" for p in value.split(".")) else AGAINST
    return SILENT


def _listed(kind: int, value: str, digits: str) -> int:
    if kind == EMAIL:
        return FOR if re.split(r"[^A-Za-z0-9]+", value)[-1].lower() in _DOMAINS else AGAINST
    if kind == IP:
        return AGAINST if digits[0] == "0" or value.startswith(("127.", "255.")) else FOR
    if kind == CARD:
        return FOR if _ISSUED.match(digits) else AGAINST
    if kind == PHONE:
        if value[0] != "+":
            return SILENT
        return FOR if any(digits[:n] in _CALLING for n in (1, 2, 3)) else AGAINST
    if kind == ACCOUNT:
        return FOR if value[:2] in _COUNTRIES else AGAINST
    if kind == NAME:
        return FOR if value.split()[0] in _FIRST_NAMES else SILENT
    return SILENT


def _form(kind: int, value: str, digits: str) -> int:
    if kind == EMAIL:
        return FOR if value[0].isalnum() and ".." not in value else AGAINST
    if kind == CARD:
        groups = re.split(r"[\x20.-]+", value)
        return FOR if len(groups) == 1 or {len(g) for g in groups[:-1]} <= {4} else AGAINST
    if kind == PHONE:
        if _DATE.fullmatch(value) or (value[0] != "+" and re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", value)):
            return AGAINST
        return FOR if re.search(r"[0-9][\x20().-]+[0-9]", value) else SILENT
    if kind == NAME:
        return FOR if " " in value else SILENT
    return SILENT


def votes(text: str, start: int, kind: int, end: int, is_base: bool) -> list[int]:
    """The vote of each labeler on one candidate."""
    value = text[start:end]
    digits = _NO_DIGIT.sub("", value)
    cue = [w.lower() for w in _WORDS.findall(text, max(0, start - 40), start)][-4:]
    if any(w in _CUES[kind] for w in cue):
        context = FOR
    else:
        context = AGAINST if cue and cue[-1] in _AGAINST_CUES else SILENT
    before, after = text[start - 1 : start], text[end : end + 1]
    apart = not (before.isalnum() or before in ("_", "/", "=", "#") and before) and not (after.isalnum() or after in ("_", "/", "=") and after)
    # of the wider forms, those fail the base pattern that have its digits but not its check
    pattern = FOR if is_base else AGAINST if kind == CARD else SILENT
    return [pattern, _check(kind, value, digits), _listed(kind, value, digits), context, FOR if apart else AGAINST, _form(kind, value, digits)]


def features(text: str, start: int, kind: int, end: int) -> list[str]:
    """Tokens of a candidate for the classifier: shape, checks and surroundings."""
    value = text[start:end]
    digits = _NO_DIGIT.sub("", value)
    shape = re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"[0-9]", "9", value)))[:40]
    name = KINDS[kind]
    tokens = [name, f"{name} shape {shape}", f"{name} digits {len(digits)}", f"{name} check {_check(kind, value, digits)}"]
    tokens.append(f"{name} listed {_listed(kind, value, digits)}")
    before = _WORDS.findall(text, max(0, start - 40), start)[-3:]
    tokens += [f"{name} before {w.lower()}" for w in before]
    tokens += [f"{name} after {w.lower()}" for w in _WORDS.findall(text, end, end + 24)[:1]]
    tokens.append(f"{name} edges {text[start - 1 : start] if start else ''}|{text[end : end + 1]}")
    return tokens


def vote_code(cast: list[int]) -> int:
    """The votes as one number, to the base of three."""
    code = 0
    for vote in cast:
        code = 3 * code + vote
    return code


# --- reliabilities -------------------------------------------------------------------


def estimate(counts: dict[tuple[int, int], int], rounds: int = 60) -> dict[tuple[int, int], float]:
    """Posterior of each ``(kind, vote code)`` by expectation-maximisation on their counts.

    For each kind, a share of true candidates and, per labeler, how it votes on true and
    on false ones. The prior counts say that a labeler is right rather than wrong.
    """
    posterior: dict[tuple[int, int], float] = {}
    labelers = len(LABELERS)
    right, wrong, silent = 6.0, 1.0, 3.0
    prior = np.array([[right, wrong, silent], [wrong, right, silent]])
    for kind in sorted({k for k, _ in counts}):
        codes = sorted(code for k, code in counts if k == kind)
        n = np.array([counts[kind, code] for code in codes], float)
        cast = np.array([[code // 3 ** (labelers - 1 - j) % 3 for j in range(labelers)] for code in codes])
        given = np.repeat(prior[:, None, :], labelers, 1) / prior.sum(1)[0]
        share = 0.5
        for _ in range(rounds):
            odds = np.log([share, 1 - share])[:, None] + np.log(given[:, np.arange(labelers), cast]).sum(2)
            true = 1 / (1 + np.exp(np.clip(odds[1] - odds[0], -60, 60)))
            share = (n @ true + 2) / (n.sum() + 4)
            for y, weight in enumerate((n * true, n * (1 - true))):
                for v in range(3):
                    given[y, :, v] = prior[y, v] + weight @ (cast == v)
            given /= given.sum(2, keepdims=True)
        posterior.update({(kind, code): float(p) for code, p in zip(codes, true)})
    return posterior


# --- on Spark ------------------------------------------------------------------------

_SPAN = "struct<start:int,kind:int,end:int,base:boolean,code:int,tokens:array<string>>"


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def extract_candidates(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` per row.

    ``spans`` holds base spans and wider candidates with their votes and features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct(
            [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32()),
             ("tokens", pa.list_(pa.string()))]
        )
        for batch in batches:
            counts, shas, spans = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                base = base_spans(text)
                kinds = [s[1] for s in base]
                counts.append([kinds.count(k) for k in range(BASE_KINDS)])
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append([])
                for some, is_base in ((base, True), (wide_spans(text, base), False)):
                    for s in some:
                        code = vote_code(votes(text, *s, is_base))
                        spans[-1].append(dict(zip(("start", "kind", "end"), s), base=is_base, code=code, tokens=features(text, *s)))
            yield pa.record_batch(
                [batch.column(0), batch.column(1)]
                + [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE_KINDS)]
                + [pa.array(shas, pa.string()), pa.array(spans, pa.list_(span))],
                names=["row", "doc_id", *(f"n_{k}" for k in KINDS[:BASE_KINDS]), "base_sha256", "spans"],
            )

    schema = (
        "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string,"
        f" spans array<{_SPAN}>"
    )
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, schema)


def vote_posteriors(candidates: DataFrame) -> dict[tuple[int, int], float]:
    """Posterior of each vote pattern, from its counts over all candidates.

    What is collected has at most ``3 ** len(LABELERS)`` rows per kind.
    """
    counts = candidates.groupBy("kind", "code").agg(F.count("*").alias("n")).collect()
    return estimate({(r.kind, r.code): r.n for r in counts})


def _hashed(candidates: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, inputCol="tokens", outputCol="vector", binary=True).transform(candidates)


def train_classifier(candidates: DataFrame, posteriors: dict[tuple[int, int], float]) -> LogisticRegressionModel:
    """A logistic regression on all candidates: each is true with its posterior, else false."""
    spark = candidates.sparkSession
    known = spark.createDataFrame([(k, c, p) for (k, c), p in posteriors.items()], "kind int, code int, p double")
    soft = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")),
    )
    # the table of posteriors is bounded like the vote patterns
    rows = _hashed(candidates.join(F.broadcast(known), ["kind", "code"])).select("vector", F.inline(soft))
    model = LogisticRegression(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=40, regParam=1e-4, standardization=False
    )
    return model.fit(rows.filter("weight > 1e-9"))


def find_personal(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` per row of ``(doc_id, text)``.

    ``spans`` lists base spans and accepted candidates as ``kind:start:end`` by start,
    then kind; offsets are code points, ends exclusive. ``base_sha256`` covers the base
    spans alone.
    """
    parts = stage(extract_candidates(docs), "personal-parts")
    spans = stage(parts.filter("size(spans) > 0").select("row", F.inline("spans")), "personal-spans")
    wide = spans.filter("not base")
    shape = "array<struct<start:int,kind:int,end:int>>"
    if wide.isEmpty():
        added = None
    else:
        model = train_classifier(spans, vote_posteriors(spans))
        scored = model.transform(_hashed(wide)).withColumn("p", vector_to_array("probability")[1])
        added = scored.filter("p >= 0.5").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    base = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    if added is None:
        rows, shown = parts, base.cast(shape)
    else:
        rows = parts.join(added, "row", "left")
        shown = F.array_sort(F.concat(base.cast(shape), F.coalesce("added", F.array().cast(shape))))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.array_join(
        F.transform(
            shown,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS[:BASE_KINDS]), "base_sha256", text.alias("spans"))
