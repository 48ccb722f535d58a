"""Surrogates for personal data and secrets (DataFrame operations only).

Found are: assigned secrets (``password=...``), e-mail addresses, IBANs, cloud key ids, IPv4 addresses,
US social security numbers, card numbers, phone numbers, long hexadecimal secrets, and names behind a
form of address; once a name is known so, its other mentions in that text too, with the capitalised word
ahead of it inside a sentence (``Mr Smith met John Smith``).  Each entity gets a replacement derived from a secret key, its kind and its normal
form, so the same entity reads the same everywhere (a person keeps the surname with and without given
name; a phone number keeps its digits' stand-ins in every notation).  The replacement has the entity's
kind, length pattern, letter case and separators; names keep gender and script.  Replacements are
checked against each other and against the real entities of the corpus, and drawn again until different
entities have different replacements and none equals a real one.  Later draws come from ever larger
spaces (longer names and users, further private networks, at last more characters), so that this ends
however many entities there are.

Null text stays null, empty text empty, an empty table gives an empty result.  Rows are told apart by a
number of their own, so ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch

MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία")
EITHER = ("Dr", "Prof")
#: A word of a name; the s of a genitive is not part of it.
WORD = r"\p{Lu}(?:\p{L}|['’\-]\p{Lu})+"
_O = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kind -> pattern; where two match at one place, the first holds.  What follows a colon tells patterns of a kind apart.
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token)\b[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_~.\-]{6,}",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "keyid": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "ip": rf"(?<![0-9.]){_O}\.{_O}\.{_O}\.{_O}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card:grouped": r"(?<![0-9A-Za-z])(?:[2-6][0-9]{3}(?:(?: [0-9]{4}){3}(?: [0-9]{3})?|(?:-[0-9]{4}){3}(?:-[0-9]{3})?)|3[0-9]{3}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{4,5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?<![0-9]-)(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9A-Za-z])(?!-[0-9])|(?<![0-9A-Za-z.])\+[0-9](?:[ .\-]?[0-9]){8,13}(?![0-9A-Za-z])",
    "phone:bare": r"(?<![0-9A-Za-z.\-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z\-])(?!\.[0-9])",
    "card": r"(?<![0-9A-Za-z.\-])[3-6](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "name": r"(?<!\p{L})(?:" + "|".join(MALE + FEMALE + EITHER) + rf")\.? {WORD}(?: {WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Parts of the names made up, per script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge go ka ke ko la le li lo ma me mi mo na ne no ra re ri ro".split(),
    "cyrillic": "ба бе би бо да де ди до га ге го ка ке ки ко ла ле ли ло ма ме ми мо на не но ра ре ри ро са се".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γε γο κα κε κι κο λα λε λι λο μα με μι μο να νε νο ρα ρε ρι ρο σα σε".split(),
}
ENDS = {"latin": {"m": "n", "f": "ya", "s": "ner"}, "cyrillic": {"m": "н", "f": "ня", "s": "ров"}, "greek": {"m": "νος", "f": "νη", "s": "ρης"}}


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(entity: Column) -> Column:
    out = F
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        out = out.when(entity.rlike(f"^(?:{pattern})$"), kind.split(":")[0])
    return out.otherwise("mention")


def _byte(hash_col: str, i: str) -> str:
    """A number below 256 for place ``i`` of a hexadecimal digest."""
    return f"(cast(conv(substring({hash_col}, 1 + (({i}) * 2) % 62, 2), 16, 10) as int) + 31 * int(({i}) div 31))"


def _same_shape(value: str, digest: str) -> str:
    """SQL for a string in which letters and digits of ``value`` are replaced by others of their class."""
    c, r = f"substring({value}, i, 1)", _byte(digest, "i")
    chars = (
        f"case when {c} between '0' and '9' then cast({r} % 10 as string) "
        f"when {c} between 'a' and 'z' then substring('abcdefghijklmnopqrstuvwxyz', 1 + {r} % 26, 1) "
        f"when {c} between 'A' and 'Z' then substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + {r} % 26, 1) else {c} end"
    )
    return f"array_join(transform(sequence(1, char_length({value})), i -> {chars}), '')"


def _digits(digest: str, n: str) -> str:
    """SQL: ``n`` digits, none for 0."""
    return f"if({n} > 0, array_join(transform(sequence(1, greatest({n}, 1)), i -> cast({_byte(digest, 'i')} % 10 as string)), ''), '')"


def _hex_shape(value: str, digest: str) -> str:
    r = _byte(digest, "i")
    return f"array_join(transform(sequence(1, char_length({value})), i -> if(upper({value}) = {value}, upper(substring('0123456789abcdef', 1 + {r} % 16, 1)), substring('0123456789abcdef', 1 + {r} % 16, 1))), '')"


def _name(digest: str) -> Column:
    def syllables(script: str) -> str:
        table = "array(" + ",".join(f"'{s}'" for s in SYLLABLES[script]) + ")"
        return f"initcap(array_join(transform(sequence(1, 4 + attempt div 2), i -> element_at({table}, 1 + {_byte(digest, 'i')} % {len(SYLLABLES[script])})), ''))"

    out = F
    for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", ".")):
        for g in "mfs":
            out = out.when(F.col("norm").rlike(test) & (F.col("kind") == f"name_{g}"), F.concat(F.expr(syllables(script)), F.lit(ENDS[script][g])))
        out = out.when(F.col("norm").rlike(test) & (F.col("kind") == "name_u"), F.expr(syllables(script)))
    return out


def _draw() -> Column:
    """The replacement of (kind, norm) at the given attempt, in normal form."""
    d, more = "digest", "greatest(attempt - 7, 0)"
    user, host = "split_part(norm, '@', 1)", "split_part(split_part(norm, '@', 2), '.', 1)"
    number = lambda i, n: f"cast({_byte(d, str(i))} % {n} as string)"
    ip = (
        f"case when attempt < 4 then concat_ws('.', '10', {number(1, 256)}, {number(2, 256)}, {number(3, 256)}) "
        f"when attempt < 8 then concat_ws('.', '172', cast(16 + {_byte(d, '1')} % 16 as string), {number(2, 256)}, {number(3, 256)}) "
        f"else concat('fd', substring({d}, 1, 2), ':', substring({d}, 3, 4), ':', substring({d}, 7, 4), '::', substring({d}, 11, 4)) end"
    )
    kept = {"keyid": 4, "iban": 2, "card": 1}  # characters at the start that stay
    shaped = F
    for kind, n in kept.items():
        shaped = shaped.when(F.col("kind") == kind, F.expr(f"concat(substring(norm, 1, {n}), {_same_shape(f'substring(norm, {n + 1})', d)})"))
    shaped = (
        shaped.when(F.col("norm").rlike("^(?:[0-9a-f]{8,}|[0-9A-F]{8,})$") & F.col("kind").isin("hex", "secret"), F.expr(_hex_shape("norm", d)))
        # nothing to replace by its like: hexadecimal digits instead
        .when(~F.col("norm").rlike("[0-9A-Za-z]"), F.expr(_hex_shape("substring(repeat('0', char_length(norm)), 1)", d)))
        .otherwise(F.expr(_same_shape("norm", d)))
    )
    return (
        F.when(F.col("kind") == "email", F.expr(f"concat({_same_shape(user, d)}, {_digits(d, more)}, '@', {_same_shape(host, d)}, '.example.com')"))
        .when(F.col("kind") == "ip", F.expr(ip))
        .when(F.col("kind").startswith("name"), _name(d))
        .otherwise(F.concat(shaped, F.expr(_digits(d, more))))
    )


def surrogate_table(found: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``kind, norm, stand`` for the distinct entities: ``stand`` is distinct within a kind and no real entity."""
    entities = found.select("kind", "norm").distinct().withColumn("attempt", F.lit(0))

    def drawn(df: DataFrame) -> DataFrame:
        return df.withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "norm", F.col("attempt").cast("string")), 256)).withColumn("stand", _draw()).drop("digest")

    state = scratch.table(drawn(entities), "surrogates")
    while True:
        first = state.groupBy("kind", "stand").agg(F.min("norm").alias("winner"))
        real = state.select("kind", F.col("norm").alias("stand"), F.lit(True).alias("real"))
        checked = state.join(first, ["kind", "stand"]).join(real, ["kind", "stand"], "left").withColumn("again", F.coalesce("real", F.lit(False)) | (F.col("norm") != F.col("winner")))
        checked = scratch.table(checked.select("kind", "norm", "attempt", "stand", "again"), "checked")
        scratch.drop(state)
        if not checked.where("again").head(1):
            return checked.select("kind", "norm", "stand")
        moved = drawn(checked.where("again").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        state = scratch.table(checked.where("not again").select("kind", "norm", "attempt", "stand").unionByName(moved.select("kind", "norm", "attempt", "stand")), "surrogates")
        scratch.drop(checked)


def _overlay(surface: str, digits: str) -> str:
    """SQL: the digits of ``surface``, from the right, replaced by those of ``digits``; digits left over on the left stay, more digits than it has replace it whole."""
    skip = f"(char_length(regexp_replace({surface}, '[^0-9]', '')) - char_length({digits}))"
    step = f"if(substring({surface}, i, 1) between '0' and '9', named_struct('o', concat(a.o, if(a.k < {skip}, substring({surface}, i, 1), substring({digits}, a.k - {skip} + 1, 1))), 'k', a.k + 1), named_struct('o', concat(a.o, substring({surface}, i, 1)), 'k', a.k))"
    return f"if({skip} < 0, {digits}, aggregate(sequence(1, char_length({surface})), named_struct('o', '', 'k', 0), (a, i) -> {step}, a -> a.o))"


def _with_mentions(hit: DataFrame) -> DataFrame:
    """Texts with ``surfaces``: adds ``people`` (word, kind, gender of the names behind titles), the text's ``pattern``, and the mentions to ``surfaces``."""
    title = "regexp_extract(s, '^([^ ]+?)[.]? ', 1)"
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    g = f"case when {title} in ({listed(MALE)}) then 'm' when {title} in ({listed(FEMALE)}) then 'f' else 'u' end"
    hit = hit.withColumn("titled", F.filter("surfaces", lambda s: s.rlike(f"^(?:{PATTERNS['name']})$")))
    last = f"transform(titled, s -> named_struct('word', element_at(split(s, ' '), -1), 'kind', 'name_s', 'g', {g}))"
    first = f"flatten(transform(titled, s -> transform(slice(split(s, ' '), 2, size(split(s, ' ')) - 2), w -> named_struct('word', w, 'kind', concat('name_', {g}), 'g', {g}))))"
    hit = hit.withColumn("people", F.when(F.size("titled") > 0, F.expr(f"concat({last}, {first})")))
    words = F.array_join(F.array_distinct(F.transform("people", lambda x: x["word"])), "|")
    mention = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:(?<=[\p{Ll},;:] )" + WORD + " )?(?:"), words, F.lit(r")(?!\p{L})"))
    hit = hit.withColumn("pattern", F.when(F.col("people").isNotNull(), mention)).drop("titled")
    return hit.withColumn("surfaces", F.when(F.col("pattern").isNull(), F.col("surfaces")).otherwise(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))))


def _word_kind(word: str, last: str) -> str:
    """SQL: the kind of a word of a mention, from the row's ``people``."""
    return f"coalesce(get(filter(people, p -> p.word = {word}), 0).kind, concat('name_', get(filter(people, p -> p.word = {last}), 0).g), 'name_u')"


def pseudonymise(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text, n_entities, kinds`` for every row: the text with surrogates, and the kinds found in order of place.

    ``carry``: columns to hand on unchanged, as ``carried`` (a struct, so that no name clashes).
    """
    scratch = Scratch(docs.sparkSession)
    more = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *more).withColumn("row", F.monotonically_increasing_id())
    likely = F.col("text").rlike(r"[@0-9=:]|\. \p{Lu}|(?:Miss|Sir|Madam|Herr|Frau|Monsieur|Señor|Mr|Mrs|Ms|Mme|Mlle|Sr|Sra|Dr|Prof|Г-н|Г-жа|Господин|Госпожа|Κύριος|Κυρία) ")
    # one pass of the patterns over all texts, written, so that rows keep their numbers; only texts with entities are shuffled afterwards
    marked = scratch.table(docs.withColumn("surfaces", F.when(likely, entities(F.col("text")))), "marked")
    carried = ["carried"] if carry else []
    hit = _with_mentions(marked.where("size(surfaces) > 0"))
    found = hit.select("row", "people", F.posexplode("surfaces").alias("place", "surface")).withColumn("kind", kind_of(F.col("surface")))
    found = scratch.table(found, "entities")
    plain = found.where("kind not in ('name', 'mention')").select(
        "row", "place", F.lit(0).alias("part"), "kind",
        F.when(F.col("kind") == "secret", F.regexp_extract("surface", r"([A-Za-z0-9+/_~.\-]{6,})$", 1)).otherwise(F.col("surface")).alias("shown"),
        F.when(F.col("kind") == "secret", F.regexp_replace("surface", r"[A-Za-z0-9+/_~.\-]{6,}$", "")).otherwise("").alias("ahead"),
    )
    plain = plain.withColumn("digits", F.regexp_replace("shown", "[^0-9]", "")).withColumn(
        "norm",
        F.when(F.col("kind") == "email", F.lower("shown")).when(F.col("kind") == "phone", F.expr("right(digits, 10)")).when(F.col("kind").isin("card", "ssn"), F.col("digits")).when(F.col("kind") == "iban", F.translate("shown", " ", "")).otherwise(F.col("shown")),
    )
    named = found.where("kind in ('name', 'mention')").select("row", "place", "people", (F.col("kind") == "name").alias("titled"), F.split("surface", " ").alias("w"))
    named = named.select("row", "place", "people", "titled", F.element_at("w", -1).alias("final"), F.size("w").alias("n"), F.posexplode("w").alias("part", "shown"))
    named = named.select(
        "row", "place", "part",
        F.when(F.col("titled") & (F.col("part") == 0), "title").when(F.col("titled") & (F.col("part") == F.col("n") - 1), "name_s").otherwise(F.expr(_word_kind("shown", "final"))).alias("kind"),
        "shown", F.when(F.col("part") > 0, " ").otherwise("").alias("ahead"), F.lower("shown").alias("norm"),
    )
    columns = ("row", "place", "part", "kind", "shown", "ahead", "norm")
    parts = plain.select(*columns).unionByName(named.select(*columns))
    table = surrogate_table(parts.where("kind <> 'title'"), key, scratch)
    shown = F.when(F.col("kind") == "title", F.col("shown")).when(F.col("kind").isin("phone", "card", "ssn"), F.expr(_overlay("shown", "stand")))
    shown = shown.when((F.col("kind") == "iban") & (F.char_length("stand") == F.char_length("norm")), F.expr("array_join(transform(sequence(1, char_length(shown)), i -> if(substring(shown, i, 1) = ' ', ' ', substring(stand, i - char_length(regexp_replace(left(shown, i), '[^ ]', '')), 1))), '')"))
    shown = shown.otherwise(F.col("stand"))
    placed = parts.join(table, ["kind", "norm"], "left").select("row", F.struct("place", "part", F.concat("ahead", shown).alias("s"), "kind").alias("x"))
    lists = placed.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("x"))
    # the pieces of one entity follow each other: a new place starts a new string
    lists = lists.select(
        "row",
        F.expr("transform(filter(x, y -> y.part = 0), y -> array_join(transform(filter(x, z -> z.place = y.place), z -> z.s), ''))").alias("stands"),
        F.expr("transform(filter(x, y -> y.part = 0), y -> if(y.kind = 'title' or y.kind like 'name%', 'name', y.kind))").alias("kinds"),
    )
    lists = scratch.table(lists, "stands")
    scratch.drop(found)
    woven = hit.select("row", "doc_id", "text", "pattern", *carried).join(lists.hint("merge"), "row", "left")
    woven = woven.withColumn("gaps", F.when(F.col("pattern").isNull(), F.split("text", ANY, -1)).otherwise(F.split("text", F.col("pattern"), -1)))
    text = F.expr("array_join(flatten(transform(gaps, (g, i) -> if(i < size(stands), array(g, stands[i]), array(g)))), '')")
    woven = woven.select("doc_id", text.alias("text"), F.size("stands").cast("bigint").alias("n_entities"), "kinds", *carried)
    rest = marked.where("surfaces is null or size(surfaces) = 0").select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"), F.array().cast("array<string>").alias("kinds"), *carried)
    return woven.unionByName(rest)
