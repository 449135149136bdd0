"""Carrier sentences with slots of all eleven entity types, negatives included, and values by arithmetic on a key.

Values are written once, as SQL expressions that Spark and other engines read
alike, so spans that are known by construction can be recomputed elsewhere.
Carriers and name parts have a fold: what is learned from one is tried on the
other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.checksums import luhn_digit, verhoeff_digit

#: Carriers of the learning fold, and those held out. A type in braces is a slot.
LEARNED = (
    "{PERSON} phoned the help desk this morning.", "Please ask {PERSON} to sign the form.", "The invoice was raised by {ORG} in March.", "We moved our account to {ORG} last year.",
    "Deliver the parcel to {ADDRESS} after six.", "She lives at {ADDRESS} with her family.", "{PERSON} works for {ORG} now.", "A letter for {PERSON} arrived at {ADDRESS} today.",
    "{ORG} opened a branch at {ADDRESS} recently.", "Identity card {AADHAAR} belongs to {PERSON}, who called twice.", "{PERSON} paid with card {CARD} at the counter.",
    "Our auditor {PERSON} needs the tax number {PAN} of {ORG} soon.", "Send it to bank code {IFSC}, attention {PERSON}.", "{PERSON} accepts money at {UPI} only.",
    "The car {VEHICLE_REG} was sold by {ORG} to {PERSON}.", "Write to {EMAIL} or call {PHONE} about the lease.", "{PERSON} ne kal {ORG} mein interview diya.", "Yeh parcel {ADDRESS} par pahunchana hai.",
    "{PERSON} garu {ADDRESS} lo untaru.", "Kripya {PERSON} ko {PHONE} par batayein.", "{ORG} wale {PERSON} se baat karo.", "My colleague {PERSON} left {ORG} in May.",
    "Is {PERSON} still the owner of {ADDRESS}?", "They met {PERSON} near the office of {ORG}.", "Dear {PERSON}, thank you for your order.", "Regards, {PERSON}, {ORG}.",
    # nothing to find
    "The meeting starts at ten and ends at noon.", "Order number 48213 is on its way.", "Kal subah ki train late thi.", "Version 2 of the report is ready for review.",
    "Monday is a holiday for the whole team.", "Press the green button to start the machine.",
)
HELD_OUT = (
    "{PERSON} asked for a new cheque book.", "I spoke with {PERSON} about the refund.", "The tender was won by {ORG} again.", "Our supplier is {ORG} since April.",
    "Ship the samples to {ADDRESS} tomorrow.", "He stays at {ADDRESS} during the week.", "{PERSON} joined {ORG} as a manager.", "{PERSON} of {ORG} lives at {ADDRESS} alone.",
    "Number {AADHAAR} was given by {PERSON} at the gate.", "Charge card {CARD} for {PERSON} please.", "{PAN} is the tax number of {ORG} here.", "Use {IFSC} when you pay {ORG} online.",
    "{UPI} is the handle of {PERSON} today.", "Vehicle {VEHICLE_REG} is parked at {ADDRESS} since noon.", "{EMAIL} and {PHONE} both reach {PERSON} quickly.", "{PERSON} ka ghar {ADDRESS} mein hai.",
    "{ORG} ne {PERSON} ko bulaya hai.", "Mee {PERSON} garu {ORG} lo pani chestunnaru.",
    # nothing to find
    "The printer on the second floor is broken.", "Room 12 has been booked from nine to five.", "Barish ki wajah se match nahi hua.", "Tuesday works better for the review.",
)
CARRIERS = LEARNED + HELD_OUT

#: Parts of names; every list has a half for each fold.
FIRST = ("Asha Ravi Meera Vijay Sunil Kavya Farhan Leela Mohan Nisha Omar Pooja Rakesh Sita Tarun Usha",
         "Anil Bhavna Chetan Divya Gopal Hema Imran Jaya Kiran Lata Manoj Neeta Pavan Rohini Suresh Tara")
LAST = ("Iyer Kapoor Nair Menon Rao Sharma Das Bose Khan Pillai Joshi Verma Reddy Sethi Ghosh Patil",
        "Bhatt Chopra Desai Fernandes Goyal Hegde Jain Kulkarni Lal Mishra Naidu Prasad Saxena Thomas Varma Yadav")
FIRM = ("Himal Surya Ganga Deccan Malabar Konark Vindhya Coastal", "Nilgiri Sahyadri Kaveri Aravalli Lotus Banyan Peacock Monsoon")
KIND = ("Textiles|Foods Ltd|Steel Works|Finance|Software Pvt Ltd|Motors|Traders|Paper Mills", "Textiles|Power Ltd|Cement Works|Finance|Systems Pvt Ltd|Tyres|Traders|Sugar Mills")
STREET = ("Temple|Lake View|Station|Hill|Palace|Market|Church|River", "Garden|Fort|College|Bridge|Mill|Harbour|Tank|Museum")
WAY = "Road|Street|Nagar|Colony"
CITY = ("Pune|Mysuru|Kochi|Jaipur|Nagpur|Bhopal|Surat|Vizag", "Indore|Madurai|Patna|Ranchi|Guntur|Nashik|Kanpur|Thrissur")
BANKS, HANDLES, STATES = "HDFC|SBIN|ICIC|UTIB|PUNB", "ybl|okaxis|paytm|ibl|upi", "KA|MH|DL|TN|AP|KL"
HOSTS = "mail.example.com|example.org|post.example.net"


def _pick(parts: str, k: str, sep: str) -> str:
    return f"split_part('{parts}', '{sep}', CAST(({k}) % {len(parts.split(sep))} + 1 AS INT))"


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR(20)), {n}, '0')"


def value_sql(k: str, fold: int) -> dict[str, str]:
    """SQL of a value of each type but those with check digits, by a key expression; ``fold`` is 0 or 1."""
    of = lambda n: f"(({k}) // {n})"
    digits = _pad(f"({k}) * 15485863 % 1000000000", 9)
    return {
        "PERSON": f"{_pick(FIRST[fold], k, ' ')} || ' ' || {_pick(LAST[fold], of(7), ' ')}",
        "ORG": f"{_pick(FIRM[fold], k, ' ')} || ' ' || {_pick(KIND[fold], of(5), '|')}",
        "ADDRESS": f"CAST(({k}) % 180 + 1 AS VARCHAR(20)) || ', ' || {_pick(STREET[fold], k, '|')} || ' ' || {_pick(WAY, of(3), '|')} || ', ' || {_pick(CITY[fold], of(11), '|')}",
        "IFSC": f"{_pick(BANKS, k, '|')} || '0' || {_pad(f'({k}) % 1000000', 6)}",
        "UPI": f"'user' || CAST({k} AS VARCHAR(20)) || '@' || {_pick(HANDLES, of(2), '|')}",
        "VEHICLE_REG": f"CASE WHEN ({k}) % 3 = 0 THEN '22BH' || {_pad(f'({k}) % 10000', 4)} || 'AA' WHEN ({k}) % 3 = 1 THEN {_pick(STATES, of(4), '|')} || {_pad(f'({k}) % 100', 2)} || 'AB' || {_pad(f'({k}) % 10000', 4)} "
                       f"ELSE {_pick(STATES, of(4), '|')} || '7C' || {_pad(f'({k}) % 10000', 4)} END",
        "EMAIL": f"'user.' || CAST({k} AS VARCHAR(20)) || '@' || {_pick(HOSTS, of(2), '|')}",
        "PHONE": f"CASE WHEN ({k}) % 3 = 0 THEN '+91' WHEN ({k}) % 3 = 1 THEN '0' ELSE '' END || '9' || {digits}",
    }


#: Lengths of the values with check digits, and of those of one shape.
FIXED_LENGTHS = {"AADHAAR": 12, "CARD": 16, "PAN": 10}


def values(key: Column, name: str, fold: int) -> dict[str, Column]:
    """A value of every type as columns; ``name`` is the column of the key."""
    out = {t: F.expr(sql.replace("//", "DIV")) for t, sql in value_sql(name, fold).items()}
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    aadhaar, card = F.concat(F.lit("8888"), pad((key * 7919 + 31) % 10**7, 7)), F.concat(F.lit("5"), pad((key * 104729 + 17) % 10**14, 14))
    letter = lambda x, n: F.chr(65 + x % n)
    out["AADHAAR"], out["CARD"] = F.concat(aadhaar, verhoeff_digit(aadhaar)), F.concat(card, luhn_digit(card))
    out["PAN"] = F.concat(letter(key, 26), letter(key + 3, 26), F.lit("Q"), F.get(F.lit(list("PCHABGJLFT")), (key % 10).cast("int")), letter(key, 7), pad(key % 10000, 4), letter(key, 11))
    return out


@dataclass(frozen=True)
class Piece:
    """A part of a carrier: a text, or a slot of a type."""

    text: str
    slot: bool


def pieces(carrier: str) -> list[Piece]:
    """The parts of a carrier in order."""
    out = []
    for part in carrier.split("{"):
        name, brace, rest = part.partition("}")
        out += [Piece(name, True), Piece(rest, False)] if brace else [Piece(part, False)]
    return [p for p in out if p.text]


def carrier_text(keys: DataFrame, key: str, held_out: bool | None = None) -> DataFrame:
    """(text_id, carrier_id, held_out, text, gold): one sentence for each key, in the carrier ``key % n``.

    ``gold`` is array<struct<start, end, entity_type>>. ``held_out`` keeps the carriers of one fold only.
    """
    which = [i for i in range(len(CARRIERS)) if held_out is None or held_out == (i >= len(LEARNED))]
    base = keys.select(F.col(key).cast("long").alias("text_id"))
    k, place = F.col("text_id"), F.col("text_id") % len(which)
    folds = {fold: values(k, "text_id", fold) for fold in (0, 1)}
    none = F.array().cast("array<struct<start:int,end:int,entity_type:string>>")
    text, gold = F.lit(None).cast("string"), none
    for n, i in enumerate(which):
        value, at, spans, parts = folds[int(i >= len(LEARNED))], F.lit(0), [], []
        for piece in pieces(CARRIERS[i]):
            part = value[piece.text] if piece.slot else F.lit(piece.text)
            if piece.slot:
                spans.append(F.struct(at.cast("int").alias("start"), (at + F.length(part)).cast("int").alias("end"), F.lit(piece.text).alias("entity_type")))
            at = at + F.length(part)
            parts.append(part)
        text = F.when(place == n, F.concat(*parts)).otherwise(text)
        gold = F.when(place == n, F.array(*spans) if spans else none).otherwise(gold)
    carrier = F.get(F.lit(which), place.cast("int"))
    return base.select("text_id", carrier.alias("carrier_id"), (carrier >= len(LEARNED)).alias("held_out"), text.alias("text"), gold.alias("gold"))


def gold_sql(table: str, key: str, types: tuple[str, ...], held_out: bool | None = None) -> str:
    """SQL of (text_id, start, end, entity_type) of the spans of some types in :func:`carrier_text`."""
    which = [i for i in range(len(CARRIERS)) if held_out is None or held_out == (i >= len(LEARNED))]
    rows = []
    for n, i in enumerate(which):
        sql, at = value_sql("k", int(i >= len(LEARNED))), "0"
        for piece in pieces(CARRIERS[i]):
            size = str(FIXED_LENGTHS.get(piece.text) or f"length({sql[piece.text]})") if piece.slot else str(len(piece.text))
            if piece.slot and piece.text in types:
                rows.append(f"""SELECT k AS text_id, ({at})::INT AS "start", ({at} + {size})::INT AS "end", '{piece.text}' AS entity_type FROM (SELECT {key}::BIGINT AS k FROM {table}) WHERE k % {len(which)} = {n}""")
            at = f"{at} + {size}"
    return " UNION ALL ".join(rows)
