"""Personal data and secrets by weak supervision, in DataFrame expressions alone.

Base spans of four kinds come from patterns and checks. Beyond them there are candidates of three kinds: ``secret`` (long
unbroken runs with a digit), ``id`` (numbers of six digits or more) and ``person`` (two or three capitalised words). Three
labelers vote on each: a pattern on its shape, a gazetteer (of words that announce it, or of given names) and its
context. Features that no labeler reads (length, variety, what follows) are bits beside the votes, so the whole corpus is
one count for each pattern of bits. On these counts, expectation-maximisation estimates how reliable each labeler is,
and a logistic span classifier for each kind is trained on the resulting probabilities. What it accepts becomes a span,
where it overlaps no base span and no span of a kind named before its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import clean_text, materialise
from .fingerprints import let

#: Kinds in order, and their patterns. The possessive and \G forms match what the plain greedy patterns
#: match, without their repeated starts inside one run.
KINDS = ("email", "ip", "card", "phone", "secret", "id", "person")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = ("secret", "id", "person")
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+",
    "id": r"(?<![A-Za-z0-9+.-])[A-Z]{0,2}+[0-9](?:[\x20-]?[0-9]){5,}+(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z0-9])[A-Z][a-z]++(?:\x20[A-Z][a-z]++){1,2}",
}
#: Words that announce something confidential, or a number of a person; given names; titles and the like.
SECRET_WORDS = ("access", "api", "apikey", "auth", "authorization", "bearer", "certificate", "client_secret", "credential", "credentials", "key", "login", "passcode", "passphrase", "passwd", "password", "private", "pwd", "secret", "session", "signature", "token")
ID_WORDS = ("account", "acct", "badge", "born", "customer", "driver", "employee", "iban", "identity", "insurance", "licence", "license", "medical", "member", "national", "passport", "patient", "policy", "routing", "sin", "social", "ssn", "student", "tax", "taxpayer", "tin", "visa", "voter")
GIVEN_NAMES = ("Alexander", "Alice", "Andrew", "Anna", "Anne", "Anthony", "Barbara", "Benjamin", "Carlos", "Charles", "Christopher", "Claire", "Daniel", "David", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Fatima", "Francesco", "George", "Hannah", "Hans", "Helen", "Henry", "Jack", "James", "Jane", "Jennifer", "Jessica", "John", "Jose", "Joseph", "Juan", "Julia", "Karen", "Kevin", "Laura", "Linda", "Lisa", "Lucas", "Luis", "Margaret", "Maria", "Marie", "Mark", "Martin", "Mary", "Matthew", "Michael", "Mohammed", "Nancy", "Olivia", "Patricia", "Paul", "Peter", "Pierre", "Richard", "Robert", "Sarah", "Sofia", "Susan", "Thomas", "William", "Wei", "Yuki")
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Madam", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Dear")
#: Bits of a candidate, the labelers' votes first.
VOTES = ("shape", "gazetteer", "context")
FEATURES = (*VOTES, "long", "varied", "parted", "closed")
#: Characters looked at on either side of a candidate.
CONTEXT = 32
#: Ends are summed in blocks, so that a text with many matches does not take the square of their number.
BLOCK = 256


def matches(text: Column, pattern: str, make) -> Column:
    """``make(match, start, end, before, after)`` of every match from left to right, in code points, end exclusive."""

    def of(parts: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.char_length(F.get(parts, i)) + F.char_length(m))
        add = lambda a, x: a + x

        def spans(sizes: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, BLOCK), F.lit(0), add))

            def with_blocks(blocks: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    end = F.aggregate(F.slice(blocks, F.lit(1), block), F.lit(0), add) + F.aggregate(F.slice(sizes, block * BLOCK + 1, i - block * BLOCK + 1), F.lit(0), add)
                    return let(end, lambda e: make(m, e - F.char_length(m), e, F.get(parts, i), F.get(parts, i + 1)))

                return F.transform(found, one)

            return let(blocks, with_blocks)

        return let(sizes, spans)

    return let(F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: of(parts, found)))


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    make = lambda m, start, end, _b, _a: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), valid(kind, m).alias("valid"))
    none = F.array().cast("array<struct<start: int, kind: int, end: int, valid: boolean>>")
    return F.filter(F.when(text.rlike(PATTERNS[kind]), matches(text, PATTERNS[kind], make)).otherwise(none), lambda s: s["valid"])


def votes_of(kind: str, m: Column, left: Column, right: Column) -> tuple[Column, Column, Column]:
    """What the shape pattern, the gazetteer and the context say of a match between ``left`` and ``right``."""
    announced = lambda words: F.lower(left).rlike(r"(^|[^a-z])(" + "|".join(words) + r")(?=[^a-z]|$)")
    if kind == "secret":
        shape = m.rlike("[A-Za-z]") & (m.rlike("^([0-9a-f]{16,}|[0-9A-F]{16,})$") | ((F.char_length(m) >= 20) & m.rlike("[a-z]") & m.rlike("[A-Z]")) | m.rlike("^(sk|pk|ghp|xox[bp]|AKIA)[_-]?[A-Za-z0-9_-]{12,}$"))
        return shape, announced(SECRET_WORDS), left.rlike(r"[=:][\x20\x09]*[\"']?$") | (left.rlike("[\"']$") & right.rlike("^[\"']"))
    if kind == "id":
        shape = m.rlike("^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$") | m.rlike("^[A-Z]{2}[0-9]{2}[ -]?[0-9]") | m.rlike("^[A-Z]{1,2}[0-9]{6,9}$")
        return shape, announced(ID_WORDS), left.rlike(r"(?i)([:#=]|\b(no|nr|num|number|id|is)\.?)[\x20\x09]*$")
    shape = ~m.rlike(r"^(The|A|An|In|On|At|And|Or|But|If|This|That|These|It|He|She|We|They|You|For|From|Of|To|With|By|As|Is|Was|Are|Not|No|New|Der|Die|Das|Le|La|Les|El|Los|Una?)\b") & (right.rlike(r"^('s\b|,|\x20(said|says|wrote|is|was|has|lives|born|and)\b)"))
    return shape, m.rlike("^(" + "|".join(GIVEN_NAMES) + ")\\b"), left.rlike(r"(^|[^A-Za-z])(" + "|".join(TITLES) + r")\.?\x20$") | left.rlike(r"(?i)\b(name|contact|signed|author|by|patient|employee|customer)\b\s*(is|:|=)?\s*$")


def candidates(text: Column, kind: str) -> Column:
    """start, end, kind and bits of each candidate."""

    def make(m: Column, start: Column, end: Column, before: Column, after: Column) -> Column:
        left, right = F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT))
        bits = (
            *votes_of(kind, m, left, right),
            F.char_length(m) >= {"secret": 32, "id": 9, "person": 14}[kind],
            F.size(F.array_distinct(F.split(m, ""))) * 2 >= F.char_length(m),
            m.rlike("[_ +/-]"),
            right.rlike(r"^([\"'.,;)\]]|$)"),
        )
        mask = sum((F.when(b, F.lit(1 << k)).otherwise(F.lit(0)) for k, b in enumerate(bits)), F.lit(0))
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), mask.alias("mask"))

    none = F.array().cast("array<struct<start: int, kind: int, end: int, mask: int>>")
    return F.when(text.rlike(CANDIDATES[kind]), matches(text, CANDIDATES[kind], make)).otherwise(none)


def votes(mask: int) -> tuple[int, ...]:
    return tuple(mask >> k & 1 for k in range(len(VOTES)))


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict[int, float]]:
    """By expectation-maximisation: share of positives, each labeler's hit and false-alarm rates, and P(positive) by mask.

    A labeler hits half of what it looks for at least. So the votes of one labeler that no other ever joins never
    make positives of their own, and a corpus without personal data has none.
    """
    share, rates = 0.3, [(0.8, 0.2)] * len(VOTES)
    posterior: dict[int, float] = {}
    for _ in range(rounds):
        for mask in counts:
            yes, no = share, 1 - share
            for v, (hit, alarm) in zip(votes(mask), rates):
                yes, no = yes * (hit if v else 1 - hit), no * (alarm if v else 1 - alarm)
            posterior[mask] = yes / (yes + no)
        total = sum(counts.values())
        positive = sum(n * posterior[m] for m, n in counts.items())
        share = min(0.99, max(1e-6, positive / total))
        new = []
        for k in range(len(VOTES)):
            hits = sum(n * posterior[m] for m, n in counts.items() if votes(m)[k])
            alarms = sum(n * (1 - posterior[m]) for m, n in counts.items() if votes(m)[k])
            new.append((min(0.99, max(0.5, (hits + 1) / (positive + 2))), max(1e-3, (alarms + 1) / (total - positive + 2))))
        rates = new
    return share, rates, posterior


def train_classifier(counts: dict[int, int], target: dict[int, float], steps: int = 600) -> list[float]:
    """Logistic weights of the features, and the bias, on counts of patterns and their probabilities.

    Positives and negatives weigh alike in sum, as the first may be very few.
    """
    total = sum(counts.values())
    positive = sum(n * target[m] for m, n in counts.items())
    up, down = 0.5 / max(positive, 1e-9), 0.5 / max(total - positive, 1e-9)
    w = [0.0] * (len(FEATURES) + 1)
    for _ in range(steps):
        grad = [0.001 * x for x in w]
        for mask, n in counts.items():
            x = [*((mask >> k) & 1 for k in range(len(FEATURES))), 1]
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(w, x))))))
            slope = n * (up * target[mask] * (p - 1) + down * (1 - target[mask]) * p)
            for k, v in enumerate(x):
                grad[k] += slope * v
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return w


def accepted(counts: dict[int, int], threshold: float) -> list[int]:
    """The patterns of bits that the classifier takes for personal data; none where no pattern is likely to be."""
    _, _, target = reliabilities(counts)
    if max(target.values()) <= threshold:
        return []
    w, logit = train_classifier(counts, target), math.log(threshold / (1 - threshold))
    return sorted(m for m in counts if sum(a * b for a, b in zip(w, [*((m >> k) & 1 for k in range(len(FEATURES))), 1])) > logit)


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_spans (of both).

    Null text counts as empty. Spans are ``kind:start:end`` in code points, by start and then kind, joined by commas;
    no span gives an empty string. Matches that fail their check are dropped. Rows without or with repeated doc_ids
    are judged each. An empty table gives no rows; other columns are ignored.
    """
    text = F.col("body")
    found = docs.select("doc_id", clean_text().alias("body")).select("doc_id", F.concat(*[base_spans(text, k) for k in PATTERNS]).alias("base"), F.concat(*[candidates(text, k) for k in ADDED]).alias("candidates"))
    found = materialise(found, "spans")
    apart = lambda spans: lambda c: ~F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    free = F.filter("candidates", apart(F.col("base")))
    rows = found.select(F.explode(free).alias("c")).groupBy("c.kind", "c.mask").agg(F.count(F.lit(1)).alias("n")).collect()  # 2^7 of each kind at most
    added = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    for kind in (KINDS.index(k) for k in ADDED):
        if masks := accepted({r["mask"]: r["n"] for r in rows if r["kind"] == kind}, threshold) if any(r["kind"] == kind for r in rows) else []:
            judged = F.filter(free, lambda c: (c["kind"] == kind) & c["mask"].isin(masks))
            judged = F.transform(judged, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
            added = let(added, lambda before: F.concat(before, F.filter(judged, apart(before))))
    base = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    found = found.select("doc_id", "base", base.alias("sorted"), F.array_sort(F.concat(base, added)).alias("all"))
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(said(F.col("sorted")), 256).alias("base_sha256"),
        said(F.col("all")).alias("spans"),
        F.size("all").cast("long").alias("n_spans"),
    )
