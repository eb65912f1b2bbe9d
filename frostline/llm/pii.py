r"""Personal data replaced by surrogates, with DataFrame operations only.

Detected are e-mail addresses, phone numbers, payment card numbers and IBANs that pass their checks, IPv4
and IPv6 addresses, social security numbers, access keys, values given to names such as password or
token, and names of persons: after a title, after words of naming ("my name is", "signed by"), or capitalised
words from a known given name on. Known given names are a parameter, a table of any size, which is joined.
Each different entity gets one surrogate for the whole corpus, drawn by SHA-256 of a secret key, the type,
the entity and the number of the attempt:
- of the same type and format: digits stand for digits, letters for letters of the same case, marks
  stay, cards and IBANs pass their checks, phone numbers keep their country code, addresses end in the
  reserved domain `example`, IPv4 addresses begin with the reserved 240 to 254, IPv6 addresses with the
  documentation prefix 2001:db8 (all eight groups are written out), social security numbers with 9,
  which is never issued; where a format has too few free values, surrogates grow by some characters, more
  from attempt to attempt;
- given names for given names of the same gender and script, surnames for surnames of the script, part by
  part where hyphens or apostrophes join them;
- coreferent: the same number in another spelling, national or international, the same address in other
  case, or the same name in another mention gets the same surrogate, spelt like the mention. A national
  number that begins with 0 is one of the country whose code is given, if it is.
Surrogates are checked against each other and against all entities found: of those that draw the same
one only the least entity keeps it, and none keeps one that is itself an entity; the others draw
again, until all differ. So different entities stay different. A phone number has 7 digits or more.

The patterns run over each text once, behind a guard that lets texts without any sign of an entity pass;
texts cut at their mentions are written, and all else works on these.

Null and empty texts stay. Rows with equal id and text come out alike. Very long texts are one row in
memory; repeated entities do no harm. An empty table gives no rows. Other columns pass through, whatever
they are called, but for those called n_entities and kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import shared

#: Titles by gender, n for none.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Г-жа"],
    "n": ["Dr", "Doctor", "Prof", "Professor", "Доктор"],
}
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "Hans", "Klaus", "Stefan", "Jürgen", "Pierre", "Jean", "Luc", "Carlos", "Juan", "José", "Miguel", "Alan", "Daniel", "Mark", "George", "Henry", "Andreas", "Markus", "Wolfgang", "François", "Antoine", "Pedro", "Luis", "Raj", "Ahmed", "Omar"],
    ("f", "latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Karen", "Ursula", "Sabine", "Monika", "Heike", "Marie", "Claire", "Sophie", "Carmen", "Lucía", "Isabel", "Teresa", "Olivia", "Emma", "Emily", "Laura", "Julia", "Maria", "Petra", "Ingrid", "Camille", "Hélène", "Ana", "Elena", "Priya", "Fatima", "Aisha"],
    ("m", "cyrillic"): ["Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Павел"],
    ("f", "cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина"],
}
SYLLABLES = {
    "latin": "ba ben bor cal cor da del dor fa fen gar gel hal hen jor ka kel lan len lor ma mel mor na nor pa pel ra ren ros sal sen tal ten tor va vel wal wen zan".split(),
    "cyrillic": "ба бор вал вер гал гор дан дор жан зар кал кор лан лев мар мил нар ник пав пол рад рос сав сем тар тих фад хар яр".split(),
}
#: Words of naming that a name follows.
NAMING = ["my name is", "i am called", "signed by", "written by", "sincerely,", "regards,", "name:", "author:", "contact:", "ich heiße", "mein name ist", "je m'appelle", "je m’appelle", "me llamo", "mi nombre es"]
#: Capitalised words that are no surname, as in headings.
NO_NAME = "A An And Are As At But By Can Could Das Der Did Die Does El En Es Est Et For From Fue Goes Had Has Hat He Her His How I If In Is Ist It La Le Les Los May Must My Not Of On Or Our Said Says Shall She Should That The Their Then They This To Und Va Von Was We Went Were What When Where Who Why Will With Would You Your".split()
#: Two-digit country codes of phone numbers; 1 and 7 have one digit, all others three.
COUNTRIES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Attempts that draw given names from the lists above; later ones make names up, of which there is no end.
LISTED_ATTEMPTS = 2
#: Attempts that keep the length. Whoever still has no surrogate then has a format of which most values are in use;
#: later ones grow by GROWTH more digits each, up to MOST_GROWTH, of which there are enough for any corpus.
SAME_LENGTH_ATTEMPTS, GROWTH, MOST_GROWTH = 6, 2, 12


def _any_of(names: list[str]) -> str:
    return "(?:" + "|".join(sorted(names, key=len, reverse=True)) + ")"


TITLE = _any_of([t for g in TITLES.values() for t in g])
PREFIX = rf"(?:(?i:{_any_of(NAMING)})\s(?:{TITLE}\.? )?|{TITLE}\.? )"
WORD = rf"(?!{TITLE}(?!\p{{L}}))\p{{Lu}}[\p{{L}}'’-]+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
GROUP = "[0-9A-Fa-f]{1,4}"
#: Type and pattern, in order of precedence.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{8,}[\"']?"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip6", rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*\d)(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}})(?![0-9A-Za-z:]|\.\d)"),
    ("card", r"(?<!\d)(?:3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    (
        "phone",
        r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+(?=(?:[ .-]?\(?\d\)?){7})\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,5}(?!\d)"
        r"|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.])\d{3}\.\d{3}\.\d{4}(?![\d.]\d|\d)"
        r"|(?<![\w+.,/:-])0(?:\d(?:[ .]\d{2}){4}|\d{2,4}[ /-]\d{6,8}|\d{2,4} \d{3,4} \d{3,4})(?!\d|[./-]\d)",
    ),
    ("ip", rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"),
    ("name", rf"(?<!\p{{L}})(?:{PREFIX}{WORD}(?: {WORD}){{0,2}}|{WORD}(?: {WORD}){{1,3}})"),
]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Each entity holds a digit, an @, AKIA, a title, words of naming or two capitalised words, or follows the name of a secret; other texts pass.
GUARD = rf"[0-9@]|AKIA|\p{{Lu}}[\p{{L}}'’-]+ \p{{Lu}}|(?<!\p{{L}})(?:{PREFIX})|(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]"
MARK = "￾"  # stands on either side of an entity; one of the text itself becomes an empty entity


def pieces(text: Column) -> Column:
    """The text as plain parts (even places) and mentions (odd places)."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK * 2)), ANY, f"{MARK}$0{MARK}"), MARK, -1)


def type_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Sum modulo 10 of a string of digits, doubled from the second to last on."""
    values = F.transform(F.reverse(characters(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10


def iban_rest(iban: Column) -> Column:
    """The remainder by 97 of an IBAN (no blanks), its first four characters moved to the end, letters counting from 10; 1 if it is valid."""
    moved = F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(characters(moved), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def secret_part(mention: Column) -> Column:
    return F.regexp_extract(mention, r"^[^=:]+[=:]\s?[\"']?([A-Za-z0-9+/_-]{8,})[\"']?$", 1)


def _ip6(mention: Column) -> Column:
    """All eight groups, lower-cased, without leading zeros."""
    sides = F.split(F.lower(mention), "::")
    left, right = F.split(sides[0], ":"), F.when(F.size(sides) > 1, F.split(F.get(sides, 1), ":")).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def canonical(kind: Column, mention: Column, country_code: str | None = None) -> Column:
    """What is the same in all spellings of an entity."""
    digits = _digits(F.replace(mention, F.lit("(0)"), F.lit("")))
    phone = F.when(mention.startswith("+"), F.concat(F.lit("+"), digits)).when(digits.startswith("0"), F.concat(F.lit(f"+{country_code}"), digits.substr(F.lit(2), F.length(digits))) if country_code else digits)
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "phone", phone.otherwise(F.concat(F.lit("+1"), digits)))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "ip6", _ip6(mention))
        .when(kind == "secret", secret_part(mention))
        .when(kind.startswith("given") | (kind == "surname"), F.initcap(mention))
        .otherwise(mention)
    )


def _draw(seed: Column, n: Column | int, most: Column | int) -> Column:
    """A number from 0 to most - 1 by seed, place and key."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", seed, F.lit(n).cast("string")), 256), 1, 12), 16, 10).cast("long"), F.lit(most))


def _scrambled(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """Each digit, lower and upper-case letter by another of its class; letters of hexadecimal strings from a to f."""

    def other(c: Column, i: Column) -> Column:
        letter = _draw(seed, i, F.when(hexadecimal, 6).otherwise(26))
        return (
            F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(letter + 97))
            .when(c.rlike("[A-Z]"), F.char(letter + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(characters(text), other), "")


def _made_up(seed: Column, attempt: int, script: str) -> Column:
    parts = F.array(*(F.lit(s) for s in SYLLABLES[script]))
    count = 2 + max(0, attempt) // 2
    return F.initcap(F.concat(*(F.element_at(parts, (_draw(seed, 100 + k, len(SYLLABLES[script])) + 1).cast("int")) for k in range(count + 1))))


def country(phone: Column) -> Column:
    """Length of the plus sign and country code of a canonical number, or of the 0 that it begins with."""
    return F.when(~phone.startswith("+"), 1).when(phone.rlike(r"^\+[17]"), 2).when(phone.rlike(rf"^\+{_any_of(COUNTRIES)}"), 3).otherwise(4)


def surrogate(kind: Column, entity: Column, key: str, attempt: int) -> Column:
    """What stands for the entity (both canonical), as drawn at this attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, F.lit(attempt)), 256)
    no = F.lit(False)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    labels = F.regexp_replace(domain, r"\.[^.]+$", "")
    longer = F.substring(seed, 1, 8) if attempt >= SAME_LENGTH_ATTEMPTS else F.lit("")
    grown = min(GROWTH * (attempt - SAME_LENGTH_ATTEMPTS + 1), MOST_GROWTH)
    more = F.lpad(_draw(seed, 98, 10**grown).cast("string"), grown, "0") if attempt >= SAME_LENGTH_ATTEMPTS else F.lit("")
    cyrillic = entity.rlike(r"\p{IsCyrillic}")

    def by_script(latin: Column, other: Column) -> Column:
        return F.when(cyrillic, other).otherwise(latin)

    def given(genders: str) -> Column:
        if attempt < LISTED_ATTEMPTS:
            lists = [[n for g in genders for n in GIVEN[g, s]] for s in ("latin", "cyrillic")]
            return by_script(*(F.element_at(F.array(*map(F.lit, names)), (_draw(seed, 0, len(names)) + 1).cast("int")) for names in lists))
        ends = {"m": ("o", "ий"), "f": ("a", "а"), "mf": ("is", "ья")}[genders]
        return by_script(*(F.concat(_made_up(seed, attempt - LISTED_ATTEMPTS, s), F.lit(e)) for s, e in zip(("latin", "cyrillic"), ends, strict=True)))

    surname = by_script(_made_up(seed, attempt, "latin"), F.concat(_made_up(seed, attempt, "cyrillic"), F.when(F.lower(entity).endswith("а"), "ова").otherwise("ов")))
    digits = _scrambled(entity, seed, no)
    body = F.concat(entity.substr(F.lit(1), F.lit(1)), digits.substr(F.lit(2), F.length(entity) - 2), more)
    check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    octets = F.concat_ws(".", *((_draw(seed, k, 15 if k == 0 else 254) + (240 if k == 0 else 1)).cast("string") for k in range(4)), *([more] if attempt >= SAME_LENGTH_ATTEMPTS else []))
    groups = F.concat_ws(":", F.lit("2001:db8"), *(F.lower(F.hex(_draw(seed, k, 65536))) for k in range(6)))
    kept, first = country(entity), (_draw(seed, 99, 8) + 2).cast("string")
    account = F.concat(digits.substr(F.lit(5), F.length(entity)), more)
    land = F.substring(entity, 1, 2)
    iban = F.concat(land, F.lpad((98 - iban_rest(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0"), account)
    return (
        F.when(kind == "email", F.concat(_scrambled(local, seed, no), longer, F.lit("@"), _scrambled(labels, F.concat(seed, F.lit("d")), no), F.lit(".example")))
        .when(kind == "phone", F.concat(entity.substr(F.lit(1), kept), first, digits.substr(kept + 2, F.length(entity)), more))
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "ssn", F.concat(F.lit("9"), digits.substr(F.lit(2), F.length(entity)), more))
        .when(kind == "ip", octets)
        .when(kind == "ip6", groups)
        .when(kind == "iban", iban)
        .when(kind == "key", F.concat(F.lit("AKIA"), digits.substr(F.lit(5), F.length(entity)), more))
        .when(kind == "secret", F.concat(_scrambled(entity, seed, entity.rlike("^[0-9a-f]+$")), longer))
        .when(kind == "given_m", given("m"))
        .when(kind == "given_f", given("f"))
        .when(kind == "given_n", given("mf"))
        .otherwise(surname)
    )


def space(kind: Column) -> Column:
    """Kinds within which surrogates differ: given names of any gender are one."""
    return F.when(kind.startswith("given"), "given").otherwise(kind)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, surrogate for each different (kind, entity): surrogates of a kind all differ from each
    other and from the entities. Each attempt is a few joins; the driver learns only whether any is left."""
    found = shared.written(entities.select("kind", "entity").distinct(), "entities")
    real = found.select(space(F.col("kind")).alias("space"), F.col("entity").alias("surrogate")).distinct()
    left, done, attempt = found, None, 0
    while True:
        drawn = left.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), key, attempt)).withColumn("space", space(F.col("kind"))).join(real, ["space", "surrogate"], "left_anti")
        if done is not None:
            drawn = drawn.join(done.select(space(F.col("kind")).alias("space"), "surrogate"), ["space", "surrogate"], "left_anti")
        first = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("entity", "kind")).alias("x"))
        solved = shared.written(first.select("x.kind", "x.entity", "surrogate"), "surrogates")
        left = shared.written(left.join(solved, ["kind", "entity"], "left_anti"), "entities")
        done = solved if done is None else done.union(solved)
        attempt += 1
        if left.isEmpty():
            return done


def known_names(names: dict[tuple[str, str], list[str]]) -> list[tuple[str, str]]:
    """(name, gender) of lists by (gender, script); a name in lists of both genders is of none."""
    out: dict[str, str] = {}
    for (gender, _), listed in names.items():
        for name in listed:
            out[name] = gender if out.get(name, gender) == gender else "n"
    return sorted(out.items())


def name_words(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mention, at (place), word, kind (null: it stays) of the words of each mention that may be a name; mentions
    without a name have no rows. names: a table (word, gender)."""
    after = F.regexp_extract("mention", f"^{PREFIX}", 0)
    words = mentions.select("mention", after.alias("prefix")).withColumn("rest", F.expr("substring(mention, length(prefix) + 1)"))
    each = words.select("mention", "prefix", F.posexplode(F.split("rest", " ")).alias("at", "word"))
    known = names.select(F.col("word").alias("first"), "gender")
    each = each.withColumn("first", F.initcap(F.regexp_extract("word", r"^\p{L}+", 0))).join(known, "first", "left")
    rows = each.groupBy("mention", "prefix").agg(F.sort_array(F.collect_list(F.struct("at", "word", "gender"))).alias("w"))  # a few words each
    stop = F.filter("w", lambda x: x["word"].isin(*NO_NAME))
    n = F.when(F.size(stop) > 0, stop[0]["at"]).otherwise(F.size("w"))  # words before the first that ends a name
    rows = rows.withColumn("n", n).withColumn("low", F.array_min(F.transform(F.filter("w", lambda x: x["gender"].isNotNull()), lambda x: x["at"])))

    def gender_at(k: Column) -> Column:
        return F.get("w", k)["gender"]

    high = F.col("low")  # the last of the known given names that follow each other
    for _ in range(3):
        high = F.when((high + 1 < F.col("n")) & gender_at(high + 1).isNotNull(), high + 1).otherwise(high)
    rows = rows.withColumn("high", high)
    titled = F.col("prefix").rlike(rf"{TITLE}\.? $")
    of_title = F.when(F.col("prefix").rlike(rf"(?<!\p{{L}}){_any_of(TITLES['f'])}\.? $"), "f").when(F.col("prefix").rlike(rf"(?<!\p{{L}}){_any_of(TITLES['m'])}\.? $"), "m")
    bare = F.col("prefix") == ""
    first = F.when(bare, F.col("low")).otherwise(0)
    last = F.when(~bare, F.col("n") - 1).when(F.col("high") + 1 < F.col("n"), F.col("high") + 1).when(F.col("high") > F.col("low"), F.col("high"))
    rows = rows.withColumns({"first": first, "last": last}).where((F.col("n") > 0) & (F.col("last") >= F.col("first")))

    def kind(x: Column) -> Column:
        gender = F.coalesce(of_title, x["gender"], gender_at(F.col("first")), F.lit("n"))
        alone = (F.col("first") == F.col("last")) & ~titled  # after words of naming
        return F.when((x["at"] < F.col("first")) | (x["at"] > F.col("last")), F.lit(None).cast("string")).when((x["at"] == F.col("last")) & ~alone, "surname").otherwise(F.concat(F.lit("given_"), gender))

    return rows.select("mention", "prefix", F.explode(F.transform("w", lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word"), kind(x).alias("kind")))).alias("x")).select("mention", "prefix", "x.*")


def _cased(mention: Column, text: Column) -> Column:
    """The text with capitals where the mention has some; all in capitals like it."""
    some = F.array_join(F.transform(characters(text), lambda c, i: F.when(F.get(characters(mention), i).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    return F.when(F.upper(mention) == mention, F.upper(text)).otherwise(some)


def _spelt(kind: Column, mention: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of the mention."""
    national = F.when(_digits(mention).startswith("0"), F.concat(F.lit("0"), surrogate.substr(country(entity) + 1, F.length(surrogate)))).otherwise(surrogate.substr(country(entity) + 1, F.length(surrogate)))
    own = F.when((kind == "phone") & entity.startswith("+") & ~mention.startswith("+"), national).otherwise(surrogate)
    plain = F.when(kind == "phone", F.replace(mention, F.lit("(0)"), F.lit(f"({MARK})"))).otherwise(mention)  # a 0 that isn't dialled from abroad
    step = F.aggregate(
        characters(plain), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike("[A-Za-z0-9+]"), F.struct(F.concat(a["out"], own.substr(a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
    )
    step = shared.let(step, lambda x: F.replace(F.concat(x["out"], own.substr(x["at"], F.length(own))), F.lit(MARK), F.lit("0")))  # what has grown comes last
    local, domain = F.substring_index(surrogate, "@", 1), F.substring_index(surrogate, "@", -1)
    mail = F.concat(_cased(F.substring_index(mention, "@", 1), local), F.lit("@"), _cased(F.substring_index(mention, "@", -1), domain))
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), step)
        .when(kind == "secret", F.replace(mention, entity, surrogate))
        .when(kind == "email", mail)
        .when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(surrogate))
        .otherwise(surrogate)
    )


def replacements(found: DataFrame, key: str, names: DataFrame, country_code: str | None = None) -> DataFrame:
    """mention, kind, replacement of each different mention (a table with a column mention)."""
    typed = found.select("mention").distinct().withColumn("kind", type_of(F.col("mention"))).where("kind IS NOT NULL")
    passes = F.when(F.col("kind") == "card", luhn(_digits(F.col("mention"))) == 0).when(F.col("kind") == "iban", iban_rest(F.replace("mention", F.lit(" "), F.lit(""))) == 1).otherwise(True)
    kinds = shared.written(typed.where(passes), "mentions")
    plain = kinds.where("kind <> 'name'").select("mention", F.lit("").alias("prefix"), F.lit(0).alias("at"), F.lit(0).alias("part"), F.col("mention").alias("word"), "kind", F.col("kind").alias("of"))
    named = name_words(kinds.where("kind = 'name'"), names)
    # the parts of a word and the marks that join them; single letters stay
    parts = named.select("mention", "prefix", "at", "kind", F.posexplode(F.split("word", "(?<=[-'’])|(?=[-'’])")).alias("part", "word"))
    parts = parts.select("mention", "prefix", "at", "part", "word", F.when(F.length("word") > 1, F.col("kind")).alias("kind"), F.lit("name").alias("of"))
    words = plain.unionByName(parts).withColumn("entity", canonical(F.col("kind"), F.col("word"), country_code))
    words = shared.written(words, "words")
    # a given name whose mentions tell one gender has it everywhere
    gendered = words.where("kind IN ('given_m', 'given_f')").groupBy("entity").agg(F.collect_set("kind").alias("genders")).where(F.size("genders") == 1).select("entity", F.col("genders")[0].alias("gendered"))
    words = shared.written(words.join(gendered, "entity", "left").withColumn("kind", F.when(F.col("kind") == "given_n", F.coalesce("gendered", "kind")).otherwise(F.col("kind"))).drop("gendered"), "entities")
    drawn = surrogates(words.where("kind IS NOT NULL"), key)
    spelt = words.join(drawn, ["kind", "entity"], "left").withColumn("new", F.when(F.col("kind").isNull(), F.col("word")).otherwise(_spelt(F.col("kind"), F.col("word"), F.col("entity"), F.col("surrogate"))))
    of_word = spelt.groupBy("mention", "prefix", "of", "at").agg(F.sort_array(F.collect_list(F.struct("part", "new"))).alias("new"))  # the parts of one word
    of_word = of_word.select("mention", "prefix", "of", "at", F.array_join(F.transform("new", lambda x: x["new"]), "").alias("new"))
    grouped = of_word.groupBy("mention", "prefix", "of").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new"))  # the words of one mention
    return grouped.select("mention", F.col("of").alias("kind"), F.concat("prefix", F.array_join(F.transform("new", lambda x: x["new"]), " ")).alias("replacement"))


def pseudonymise(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
    names: DataFrame | None = None, country_code: str | None = None,
) -> DataFrame:
    """`docs` with surrogates in its text, and n_entities (mentions replaced) and kinds (sorted, by commas), which
    take the place of columns of these names. names: a table (word, gender: m, f or n) of given names, by
    default that of GIVEN; country_code: of the country whose national numbers begin with 0, such as 49."""
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    if names is None:
        names = spark.createDataFrame(known_names(GIVEN), "word string, gender string")
    others = [c for c in docs.columns if c not in (text_col, "n_entities", "kinds")]
    # whatever the columns are called, they don't clash below
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)), F.lit(0).alias("none"))
    parts = F.when(text.rlike(GUARD), pieces(text)).otherwise(F.array(text))
    cut = shared.written(docs.select(own.alias("own"), F.when(text.isNotNull(), parts).alias("parts")).withColumn("number", F.monotonically_increasing_id()), "pieces")
    some = cut.where(F.size("parts") > 1)
    mentions = F.array_distinct(F.filter("parts", lambda p, i: (i % 2 == 1) & (p != "")))
    found = some.select("number", F.explode(mentions).alias("mention"))
    new = F.map_from_entries(F.collect_set(F.struct("mention", F.struct("replacement", "kind")))).alias("new")  # of one text
    known = shared.written(replacements(found, key, names, country_code), "replacements")  # a table of its own, so that Spark can split the join at a common mention
    joined = some.join(found.join(known, "mention").groupBy("number").agg(new), "number", "left")
    none = F.create_map().cast("map<string,struct<replacement:string,kind:string>>")
    joined = joined.withColumn("new", F.coalesce("new", none))

    def put(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, p).when(p == "", F.lit(MARK)).otherwise(F.coalesce(F.try_element_at("new", p)["replacement"], p))

    hits = F.filter("parts", lambda p, i: (i % 2 == 1) & F.try_element_at("new", p).isNotNull())
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(F.map_values("new"), lambda x: x["kind"]))), ",")
    changed = joined.select("own", F.array_join(F.transform("parts", put), "").alias("text"), F.size(hits).cast("long").alias("n"), kinds.alias("kinds"))
    rest = cut.where(F.coalesce(F.size("parts"), F.lit(0)) <= 1).select("own", F.get("parts", F.lit(0)).alias("text"), F.lit(0).cast("long").alias("n"), F.lit("").alias("kinds"))
    both = rest.union(changed)
    return both.select(*(F.col("own")[f"c{k}"].alias(c) for k, c in enumerate(others)), F.col("text").alias(text_col), F.col("n").alias("n_entities"), "kinds")
