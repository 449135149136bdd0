"""Evaluation tables: injected texts with known spans, scores, bypass cases, echo forms, latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.checksums import luhn_digit, verhoeff_digit
from sparkveil.functions.quantiles import quantiles

# ---------------------------------------------------------------- injected texts


def entity_values(key: Column) -> dict[str, Column]:
    """A synthetic value of each structured type, by arithmetic on a key."""
    pad = lambda x, n: F.lpad((x).cast("string"), n, "0")
    letter = lambda x, n: F.chr(65 + x % n)
    aadhaar = F.concat(F.lit("9999"), pad((key * 7919 + 104729) % 10**7, 7))
    card = F.concat(F.lit("4"), pad((key * 104729 + 7919) % 10**14, 14))
    return {
        "AADHAAR": F.concat(aadhaar, verhoeff_digit(aadhaar)),
        "CARD": F.concat(card, luhn_digit(card)),
        "PAN": F.concat(letter(key, 26), letter(key + 7, 26), F.lit("XP"), letter(key, 7), pad(key % 10000, 4), letter(key, 11)),
        "IFSC": F.concat(F.lit("HDFC0"), pad(key % 10**6, 6)),
        "UPI": F.concat(F.lit("user"), key.cast("string"), F.lit("@ybl")),
        "VEHICLE_REG": F.concat(F.lit("KA"), pad(key % 100, 2), F.lit("AB"), pad(key % 10000, 4)),
        "EMAIL": F.concat(F.lit("user"), key.cast("string"), F.lit("@mail.example.com")),
        "PHONE": F.concat(F.lit("+919"), pad(key * 15485863 % 10**9, 9)),
    }


#: Carrier sentences of our own; a type in braces is a slot.
TEMPLATES = (
    "Identity number {AADHAAR} was checked and {PHONE} was called.",
    "Paid with {CARD} by holder {PAN} today.",
    "Transfer via {IFSC} using {UPI} please.",
    "Vehicle {VEHICLE_REG} belongs to {EMAIL} now.",
    "Kripya {PHONE} par call karein aur PAN {PAN} dijiye.",
)


def _pieces(template: str) -> list[tuple[str, bool]]:
    out = []
    for part in template.split("{"):
        name, brace, rest = part.partition("}")
        out += [(name, True), (rest, False)] if brace else [(part, False)]
    return [p for p in out if p[0]]


def injected_text(keys: DataFrame, key: str, types=None) -> DataFrame:
    """(text_id, template_id, text, gold): one sentence for each key, gold spans by construction."""
    k = F.col(key).cast("long")
    values = entity_values(k)
    text = gold = None
    for i, template in enumerate(TEMPLATES):
        at, spans, parts = F.lit(0), [], []
        for part, is_slot in _pieces(template):
            value = values[part] if is_slot else F.lit(part)
            if is_slot:
                spans.append(F.struct(at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end"), F.lit(part).alias("entity_type")))
            at = at + F.length(value)
            parts.append(value)
        here = k % len(TEMPLATES) == i
        text = F.when(here, F.concat(*parts)) if text is None else text.when(here, F.concat(*parts))
        gold = F.when(here, F.array(*spans)) if gold is None else gold.when(here, F.array(*spans))
    return keys.select(k.alias("text_id"), (k % len(TEMPLATES)).cast("int").alias("template_id"), text.alias("text"), gold.alias("gold"))


# ---------------------------------------------------------------- scoring


def confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(entity_type, tp, fp, fn) over exact (example_id, start, end, entity_type) multisets; repeated predictions are fp."""
    keys = ["example_id", "start", "end", "entity_type"]
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    p = predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    both = g.join(p, keys, "full_outer").select("entity_type", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    tp = F.least("g", "p")
    return both.groupBy("entity_type").agg(F.sum(tp).alias("tp"), F.sum(F.col("p") - tp).alias("fp"), F.sum(F.col("g") - tp).alias("fn"))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support; 0.0 where a denominator is 0."""
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return counts.withColumns({"precision": precision, "recall": recall, "f1": share(2.0 * tp, 2 * tp + fp + fn), "support": tp + fn})


# ---------------------------------------------------------------- bypass transforms and verifiers

#: Number words, and the look-alike that takes the place of the first letter, by type.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
HOMOGLYPHS = {"PAN": "\u0410", "IFSC": "\u041d"}
_DIGITS, _LETTER_FIRST = ("AADHAAR", "CARD", "PHONE"), ("PAN", "IFSC", "VEHICLE_REG")
#: Types that each class of :func:`obfuscations` has a form of. UPI and EMAIL have no surrogate: their texts are refused, clean or not.
CLASS_TYPES = {
    "clean": _DIGITS + _LETTER_FIRST + ("PERSON",), "spaced_digits": _DIGITS, "number_words": _DIGITS, "base64_encoding": _DIGITS + _LETTER_FIRST,
    "homoglyphs": tuple(HOMOGLYPHS), "zero_width": _DIGITS + _LETTER_FIRST, "pii_in_code": _DIGITS + _LETTER_FIRST, "transliterated_names": ("PERSON",),
}
#: Names of the bypass cases in two scripts.
NAME_PAIRS = (("Arjun Mehta", "अर्जुन मेहता"), ("Neha Gupta", "नेहा गुप्ता"))


def obfuscations(value: Column, entity_type: Column | None = None) -> dict[str, Column]:
    """The forms that hide a value from pattern detectors, by class; ``homoglyphs`` and ``transliterated_names`` need the type."""
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    word = F.lit(list(NUMBER_WORDS))
    forms = {
        "spaced_digits": F.regexp_replace(value, "(.{4})(?=.)", "$1 "),
        "number_words": F.array_join(F.transform(F.filter(signs, lambda c: c.between("0", "9")), lambda c: F.get(word, c.cast("int"))), " "),
        "base64_encoding": F.base64(value.cast("binary")),
        "zero_width": F.array_join(signs, "\u200b"),
        "pii_in_code": F.concat(F.lit("user_"), value, F.lit("_row")),
    }
    if entity_type is not None:
        letter, other = F.lit(None).cast("string"), F.lit(None).cast("string")
        for t, sign in HOMOGLYPHS.items():
            letter = F.when(entity_type == t, sign).otherwise(letter)
        for latin, script in NAME_PAIRS:
            other = F.when(value == latin, script).otherwise(other)
        forms |= {"homoglyphs": F.overlay(value, letter, F.lit(1), F.lit(1)), "transliterated_names": other}
    return forms


def slot_outcome(body: Column, path: str, prefix: str, suffix: str, real: Column, sent: Column) -> Column:
    """struct<decoded, original_absent, replacement_present> of a body that was sent on.

    ``real`` must be absent from the whole body; the field at the JSON ``path``
    must keep ``prefix`` and ``suffix``, with something else than ``sent``
    between. A null body, a body that is no JSON, and a missing field fail.
    """
    decoded = F.coalesce(F.try_parse_json(body).isNotNull(), F.lit(False))
    field = F.get_json_object(body, path)
    middle = F.substring(field, F.lit(len(prefix) + 1), F.length(field) - len(prefix) - len(suffix))
    replaced = field.startswith(prefix) & field.endswith(suffix) & (F.length(field) > len(prefix) + len(suffix)) & (middle != sent)
    return F.struct(decoded.alias("decoded"), (decoded & (F.instr(body, real) == 0)).alias("original_absent"),
                    (decoded & F.coalesce(replaced, F.lit(False))).alias("replacement_present"))


def caught(outcome: Column) -> Column:
    """Whether a bypass failed: the value is gone and something stands in its place."""
    return outcome["decoded"] & outcome["original_absent"] & outcome["replacement_present"]


def mismatches(cases: DataFrame) -> DataFrame:
    """Cases whose outcome is not the predicted one (null predictions are none), by case id."""
    return cases.where("predicted_caught is not null and predicted_caught != caught").orderBy("case_id")


def discovered(*parts: DataFrame) -> DataFrame:
    """All cases (case_id, ...) of several builders, ordered by id; an id that occurs twice is an error."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    count = out.groupBy("case_id").agg(F.count("*").alias("_n"))
    unique = F.when(F.col("_n") == 1, F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("case id occurs twice: "), F.col("case_id").cast("string"))))
    names = [c for c in out.columns if c != "case_id"]
    return out.join(count, "case_id").select(unique.alias("case_id"), *names).orderBy("case_id")


def recall_by_class(cases: DataFrame) -> DataFrame:
    """(bypass_class, label, caught, total, recall): recall is null without cases."""
    return cases.groupBy("bypass_class", "label").agg(
        F.count_if("caught").alias("caught"), F.count("*").alias("total"),
        F.when(F.count("*") > 0, F.count_if("caught") / F.count("*")).alias("recall"))


# ---------------------------------------------------------------- echo forms

#: Latin letters and a phonetic stand-in of another script.
_SCRIPT = ("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстувшкыз")


def echo_forms(surrogate: Column) -> dict[str, Column]:
    """How a reply may give a name back."""
    first, last = F.substring_index(surrogate, " ", 1), F.substring_index(surrogate, " ", -1)
    return {
        "exact": surrogate, "decorated": F.concat(F.lit("**"), surrogate, F.lit("**")), "case_shifted": F.upper(surrogate), "partial": first,
        "abbreviated": F.concat(F.substring(surrogate, 1, 1), F.lit(". "), last),
        "transliterated": F.translate(F.lower(surrogate), *_SCRIPT),
        "reasoned_about": F.concat(F.lit("I was given someone whose initial is "), F.substring(surrogate, 1, 1), F.lit("?")),
    }


# ---------------------------------------------------------------- latency


def stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, p95, p99 (linear interpolation), sample stdev (0 for one value), cv (0 at mean 0), min and max.

    Quantiles are exact and come from counted histograms: no task holds the values of a group.
    """
    v, g = F.col(value), F.struct(*by)
    out = df.groupBy(g.alias("g")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"))
    held = quantiles(df, by, value, (0.5, 0.95, 0.99)).select("g", F.col("q0").alias("median"), F.col("q1").alias("p95"), F.col("q2").alias("p99"))
    out = out.join(held, "g", "left").select(*[F.col("g").getField(c).alias(c) for c in by], "n", "mean", "median", "p95", "p99", "stdev", "min", "max")
    return out.withColumn("cv", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("stdev") / F.col("mean")))


def tier_class(tiers: Column) -> Column:
    """Which tiers took part: tier1_only, tier2_only, both or neither."""
    one, two = F.array_contains(tiers, 1), F.array_contains(tiers, 2)
    return F.when(one & two, "both").when(one, "tier1_only").when(two, "tier2_only").otherwise("neither")


def window_tax(with_window: Column, without: Column) -> Column:
    """Percent that the window adds; null without both or a positive base."""
    return F.when(without > 0, (with_window - without) / without * 100)


#: Events of the gateway log, and the body of its upstream timeout.
FIRST_CHUNK, FIRST_RELEASE, SPAN_SANITIZED = "latency.upstream_first_chunk", "latency.window_first_release", "pipeline.span_sanitized"
UPSTREAM_TIMEOUT = {"error": "upstream request timed out"}


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / 1000


def log_index(log: DataFrame) -> DataFrame:
    """One row per correlation_id of (line_no, event, correlation_id, timestamp_ms, tier): chunk_ms and release_ms of the last line of each event, tiers of sanitised spans."""
    last = lambda event: F.max_by("timestamp_ms", F.when((F.col("event") == event) & F.col("timestamp_ms").isNotNull(), F.col("line_no")))
    return log.where("correlation_id is not null").groupBy("correlation_id").agg(
        last(FIRST_CHUNK).alias("chunk_ms"), last(FIRST_RELEASE).alias("release_ms"),
        F.collect_set(F.when(F.col("event") == SPAN_SANITIZED, F.col("tier"))).alias("tiers"))


def first_latency(log: DataFrame, event: str, correlation_id: str) -> DataFrame:
    """(latency_ms) of the first line of an event and id; null without one."""
    return log.where((F.col("event") == event) & (F.col("correlation_id") == correlation_id)).agg(F.min_by("latency_ms", "line_no").alias("latency_ms"))


def request_outcome(status: Column, body: Column, client_timeout: Column, transport_error: Column) -> Column:
    """success, timeout or error; any other reply that is not 200 is fatal."""
    key, text = next(iter(UPSTREAM_TIMEOUT.items()))
    timed_out = (status == 504) & (F.try_variant_get(F.try_parse_json(body), f"$.{key}", "string") == text) & (F.size(F.json_object_keys(body)) == 1)
    return F.when(client_timeout | F.coalesce(timed_out, F.lit(False)), "timeout").when(transport_error, "error").when(
        status == 200, "success").otherwise(F.raise_error(F.concat(F.lit("unexpected status "), status.cast("string"))))


def cells(requests: DataFrame, by: list[str], value: str, warmup: int = 0) -> DataFrame:
    """Per cell: attempted, timeouts, errors and the statistics of the successes (null where there are none).

    ``requests`` has seq (from 0 in its cell), outcome and the value; those with a seq below ``warmup`` are left out.
    """
    kept = requests.where(F.col("seq") >= warmup)
    count = kept.groupBy(*by).agg(F.count("*").alias("attempted"), F.count_if(F.col("outcome") == "timeout").alias("timeouts"), F.count_if(F.col("outcome") == "error").alias("errors"))
    return count.join(stats(kept.where("outcome = 'success'"), by, value), by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


# ---------------------------------------------------------------- hard cases


def hard_cases(keys: DataFrame, key: str) -> DataFrame:
    """(text_id, text, gold): one text for each key, of eight kinds that detectors get right or wrong, by key modulo 8.

    0 a PAN; 1 a PAN glued into an identifier; 2 an order number that passes the
    card check; 3 a card with a wrong digit; 4 an AADHAAR that stands twice and
    is marked once; 5 an EMAIL with invisible characters; 6 a phone with 91 and
    a value of another shape of vehicle; 7 nothing.
    """
    k = F.col(key).cast("long")
    v = entity_values(k)
    wrong = F.concat(F.substring(v["CARD"], 1, 15), ((F.substring(v["CARD"], 16, 1).cast("int") + 1) % 10).cast("string"))
    hidden = F.array_join(F.filter(F.split(v["EMAIL"], ""), lambda c: c != ""), "\u200b")
    bharat = F.concat(F.lit("22BH"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("AA"))
    mark = lambda at, value, t: F.struct(F.lit(at).alias("start"), (at + F.length(value)).cast("int").alias("end"), F.lit(t).alias("entity_type"))
    kinds = [
        (F.concat(F.lit("pan "), v["PAN"]), [mark(4, v["PAN"], "PAN")]), (F.concat(F.lit("id_"), v["PAN"], F.lit("_x")), [mark(3, v["PAN"], "PAN")]),
        (F.concat(F.lit("order "), v["CARD"]), []), (F.concat(F.lit("card "), wrong), [mark(5, wrong, "CARD")]),
        (F.concat(v["AADHAAR"], F.lit(" "), v["AADHAAR"]), [mark(0, v["AADHAAR"], "AADHAAR")]), (F.concat(F.lit("to "), hidden), [mark(3, hidden, "EMAIL")]),
        (F.concat(F.substring(v["PHONE"], 2, 12), F.lit(" "), bharat), [mark(0, F.substring(v["PHONE"], 2, 12), "PHONE"), mark(13, bharat, "VEHICLE_REG")]),
        (F.lit("nothing here"), [])]
    text, gold = F.lit(None).cast("string"), F.lit(None)
    none = F.array().cast("array<struct<start:int,end:int,entity_type:string>>")
    gold = none
    for i, (made, spans) in enumerate(kinds):
        text = F.when(k % 8 == i, made).otherwise(text)
        gold = F.when(k % 8 == i, F.array(*spans) if spans else none).otherwise(gold)
    return keys.select(k.alias("text_id"), text.alias("text"), gold.alias("gold"))


# ---------------------------------------------------------------- labels, replies, structured bypasses

#: Labels of other vocabularies that have a type here.
FOREIGN_LABELS = {"CREDIT_CARD": "CARD", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "PERSON": "PERSON"}


def own_label(label: Column) -> Column:
    """The type of a label of any vocabulary; null for labels without one."""
    from sparkveil.operators.detect import TYPES

    return F.when(label.isin(*TYPES), label).otherwise(F.create_map(*[F.lit(x) for kv in FOREIGN_LABELS.items() for x in kv])[label])


def split_value(value: Column, cut: int) -> Column:
    """A value in two turns: array of its first ``cut`` characters and the rest."""
    return F.array(F.substring(value, F.lit(1), F.lit(cut)), F.substring(value, F.lit(cut + 1), F.length(value)))


def fragments_leaked(texts: Column, fragments: Column) -> Column:
    """Whether every fragment stands unchanged in its text: then the value got through in pieces."""
    return F.forall(F.zip_with(texts, fragments, lambda t, f: F.contains(t, f)), lambda x: x)


def key_leaked(arguments: Column, value: Column) -> Column:
    """Whether a value is still a key of the JSON object in ``arguments``."""
    return F.coalesce(F.array_contains(F.json_object_keys(arguments), value), F.lit(False))
