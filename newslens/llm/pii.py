"""Surrogates for personal data: keyed, of the same type, gender, script and format.

Only DataFrame functions. A surrogate is a function of the key and the entity, so mentions of one
entity agree in all documents without any exchange of texts. Only distinct entities are shuffled,
to check that no two share a surrogate; the few that would are given another by round.
"""

from functools import reduce

from pyspark.sql import functions as F

from newslens.llm.tables import keep, let

# Given names by script and gender (men's, women's), titles by gender, alphabets, and
# syllables of surnames.
GIVEN_NAMES = [
    "James John Robert Michael William David Thomas Daniel Paul Peter Hans Jürgen Pierre Carlos".split(),
    "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Julia Laura Ursula Sabine Claire Carmen".split(),
    "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей".split(),
    "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана".split(),
    "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος".split(),
    "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Ιωάννα Δήμητρα".split(),
]
MEN, WOMEN = "Mr Herr Monsieur Señor Господин Κύριος".split(), "Mrs Ms Miss Frau Madame Mme Señora Госпожа Κυρία".split()
TITLES = [*MEN, *WOMEN, "Dr"]
# In capitals, these are words or units as often as titles.
NOT_IN_CAPITALS = ["Ms", "Miss", "Mme", "Dr"]
CAPITAL_TITLES = [t.upper() for t in TITLES if t not in NOT_IN_CAPITALS]
# By script, in the order of the given names: pattern, alphabet, syllables.
SCRIPTS = [
    (r"\p{IsLatin}", "abcdefghijklmnopqrstuvwxyz",
     "bar del fen gor hal jun kes lim mor nav pol rit sol tav vin wes".split()),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя",
     "бар дел фен гор хал жун кес лим мор нав пол рит сол тав вин зес".split()),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω",
     "βαρ δελ φεν γορ χαλ ζυν κες λιμ μορ ναβ πολ ριτ σολ ταβ βιν ξες".split()),
]

_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_CAPITALS = r"\p{Lu}{2,}(?:-\p{Lu}{2,})?"
_GIVEN = "|".join(name for names in GIVEN_NAMES for name in names)
# Patterns start behind anything but a letter or digit, and fail on the first character if they can.
KINDS = {
    "email": r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"\d{1,3}(?<!\.\d{1,3})(?:\.\d{1,3}){3}(?!\.?\d)",
    "card": r"\d{4}(?:\d{12}|(?: \d{4}){3}|(?:-\d{4}){3})(?!\d)",
    "person_number": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": (
        r"(?=[\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}])"
    ),
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "name": (
        rf"(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? (?:{_WORD} )?{_WORD}|(?:{_GIVEN}) {_WORD}"
        rf"|(?:{'|'.join(CAPITAL_TITLES)})\.? (?:{_CAPITALS} )?{_CAPITALS})"
        r"(?![\p{L}\p{N}])"
    ),
}
# Of two that start at the same place the first is taken.
ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"
_DIGIT_KINDS = ["card", "person_number", "phone"]


def mentions(text):
    """Array of (kind, raw, entity). Mentions of one entity have equal `entity`, whatever their
    letter case, spacing or punctuation; of a name the surname counts. A colon ends the country
    code of a phone number."""

    def read(raw):
        kind = reduce(
            lambda other, k: F.when(raw.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(other),
            reversed(KINDS), F.lit("name"),
        )

        def entity(kind):
            return (
                F.when(kind == "phone", F.regexp_replace(
                    F.regexp_replace(raw, r"^\+(\d{1,3})[ .-]?(?=[(\d])", "$1:"), r"[^\d:]", ""))
                .when(kind.isin(_DIGIT_KINDS), F.regexp_replace(raw, r"\D", ""))
                .when(kind == "name", F.lower(F.substring_index(raw, " ", -1)))
                .otherwise(F.lower(raw))
            )

        return let(kind, lambda kind: F.struct(kind.alias("kind"), raw.alias("raw"), entity(kind).alias("entity")))

    return F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), read)


def _interleave(pieces, fillings):
    """p0 f0 p1 f1 ... pn as one string."""
    return F.array_join(
        F.flatten(F.zip_with(pieces, fillings, lambda p, f: F.array(p, F.coalesce(f, F.lit(""))))), ""
    )


def _hex(kind, entity, turn, key):
    return F.sha2(F.concat_ws("\u001f", F.lit(key), kind, entity, turn.cast("string")), 512)


def _number(digest, i, below):
    """Keyed number under `below` for place i (from 0)."""
    two = F.substr(digest, F.pmod(i * 2, F.lit(126)) + 1, F.lit(3))
    return F.pmod(F.conv(two, 16, 10).cast("int") + i, F.lit(below))


def _chars(value):
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(value) - 1, F.lit(0))),
        lambda i: F.struct(F.substr(value, i + 1, F.lit(1)).alias("c"), i.alias("i")),
    )


def _pick(text, number):
    return F.substr(F.lit(text), number + 1, F.lit(1))


def _by_script(value, use):
    """`use(n)` for the first script, by number, with a letter in `value`; Latin if there is none."""
    others = range(1, len(SCRIPTS))
    return reduce(lambda other, n: F.when(value.rlike(SCRIPTS[n][0]), use(n)).otherwise(other), others, use(0))


def _same_shape(value, digest):
    """Letters become keyed letters of their script (those of none in SCRIPTS Latin ones), digits
    keyed digits; the rest stays."""

    def letter(x):
        return _by_script(x["c"], lambda n: _pick(SCRIPTS[n][1], _number(digest, x["i"], len(SCRIPTS[n][1]))))

    return F.array_join(
        F.transform(
            _chars(value),
            lambda x: F.when(x["c"].rlike("[0-9]"), _number(digest, x["i"], 10).cast("string"))
            .when(x["c"].rlike(r"\p{L}"), letter(x))
            .otherwise(x["c"]),
        ),
        "",
    )


def _luhn_sum(digits):
    """Sum of the Luhn check, which card numbers end on a multiple of ten."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10
        ),
    )
    return F.aggregate(values, F.lit(0), lambda total, v: total + v)


def _digits(entity, digest, kind):
    drawn = F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: _number(digest, i, 10).cast("string")), ""
    )

    def card(drawn):
        body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
        check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        return F.when(_luhn_sum(entity) % 10 == 0, F.concat(body, check)).otherwise(drawn)

    return F.when(kind == "card", let(drawn, card)).otherwise(drawn)


def surrogate_entity(kind, entity, turn, key):
    """What replaces an entity, in the normal form of entities. `turn` selects another one."""

    def made(digest):
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i, 254) + 1).cast("string")), ".")
        domain = F.regexp_replace(F.substring_index(entity, "@", -1), r"\.[a-z]+$", "")
        email = F.concat(
            _same_shape(F.substring_index(entity, "@", 1), digest), F.lit("@"),
            _same_shape(domain, F.reverse(digest)), F.lit(".example"),
        )

        def surname(syllables):
            parts = F.array(*map(F.lit, syllables))
            return F.array_join(
                F.transform(F.sequence(F.lit(1), turn + 4), lambda i: F.element_at(parts, _number(digest, i, len(syllables)) + 1)), ""
            )

        return (
            F.when(kind == "email", email)
            .when(kind == "ip", octets)
            .when(
                kind == "phone",
                F.concat(
                    F.regexp_extract(entity, "^.*:", 0),
                    _digits(F.substring_index(entity, ":", -1), digest, kind),
                ),
            )
            .when(kind.isin(_DIGIT_KINDS), _digits(entity, digest, kind))
            .when(kind == "secret", F.substr(digest, F.lit(1), F.length(entity)))
            .otherwise(_by_script(entity, lambda n: surname(SCRIPTS[n][2])))
        )

    return let(_hex(kind, entity, turn, key), made)


def _other_given_name(word, title, key):
    """A listed name becomes the one some places on in the list of its script and gender; another
    one a name of its script and the title's gender, or a made name if the title tells none."""
    listed = [F.array(*map(F.lit, names)) for names in GIVEN_NAMES]
    number = F.pmod(F.xxhash64(F.lit(key), F.lower(word)), F.lit(1 << 30))

    def drawn(gender):
        return _by_script(word, lambda n: F.element_at(
            listed[2 * n + gender], (number % len(GIVEN_NAMES[2 * n + gender]) + 1).cast("int")))

    result = F.when(title.isin([*MEN, *map(str.upper, MEN)]), drawn(0)).when(
        title.isin([*WOMEN, *map(str.upper, WOMEN)]), drawn(1)).otherwise(
        F.initcap(surrogate_entity(F.lit("name"), F.lower(word), F.lit(0), key)))
    for n, names in enumerate(GIVEN_NAMES):
        step = F.pmod(F.xxhash64(F.lit(key), F.lit(n)), F.lit(len(names) - 1)) + 1
        at = F.array_position(listed[n], F.initcap(word))
        moved = F.element_at(listed[n], (F.pmod(at - 1 + step, F.lit(len(names))) + 1).cast("int"))
        result = F.when(F.initcap(word).isin(names), moved).otherwise(result)
    return result


def _replacement(m, turn, key):
    """The surrogate in the form of the mention: its punctuation, letter case and titles."""
    raw, kind = m["raw"], m["kind"]

    def shaped(made):
        digits = _interleave(F.split(raw, r"\d", -1), F.split(F.replace(made, F.lit(":"), F.lit("")), ""))
        before = F.split(raw, " ")
        title = F.regexp_replace(before[0], r"\.", "")
        first = F.transform(F.slice(before, 1, F.size(before) - 1), lambda w: F.when(
            F.regexp_replace(w, r"\.", "").isin([*TITLES, *CAPITAL_TITLES]), w).otherwise(_other_given_name(w, title, key)))
        name = F.array_join(F.concat(first, F.array(F.initcap(made))), " ")
        name = F.when(raw == F.upper(raw), F.upper(name)).otherwise(name)
        return (
            F.when(kind.isin(_DIGIT_KINDS), digits)
            .when(kind == "name", name)
            .when((raw == F.upper(raw)) & (kind != "ip"), F.upper(made))
            .otherwise(made)
        )

    return let(surrogate_entity(kind, m["entity"], turn, key), shaped)


def later_turns(entities, key):
    """(kind, entity, turn) of the entities whose first surrogate is another's, or an entity itself.

    Of those that share a surrogate the smallest keeps it; the others take their next one, until
    all are different. Each round looks at the entities that moved, against all.
    """
    entities = keep(entities.select("kind", "entity").distinct(), "pii-entities")
    turn = F.lit(0)
    made = keep(
        entities.select("kind", "entity", turn.alias("turn"), surrogate_entity(F.col("kind"), F.col("entity"), turn, key).alias("made")),
        "pii-surrogates",
    )
    known = entities.select("kind", F.col("entity").alias("made"))
    while True:
        shared = made.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min("entity").alias("first"))
        shared = keep(shared.where("n > 1").select("kind", "made", "first"), "pii-shared")
        clashing = made.join(shared, ["kind", "made"]).where("entity != first").select("kind", "entity")
        real = made.join(known, ["kind", "made"], "left_semi").select("kind", "entity")
        moving = keep(clashing.unionByName(real).distinct(), "pii-moving")
        if moving.isEmpty():
            return made.where("turn > 0").select("kind", "entity", "turn")
        moved = made.join(moving, ["kind", "entity"], "left_semi")
        stay = made.join(moving, ["kind", "entity"], "left_anti")
        turn = F.col("turn") + 1
        moved = moved.select("kind", "entity", turn.alias("turn"), surrogate_entity(F.col("kind"), F.col("entity"), turn, key).alias("made"))
        made = keep(stay.unionByName(moved), "pii-surrogates")


def replace_entities(docs, key, doc_id="doc_id", text="text"):
    """(doc_id, text, n_replaced) for each row, personal data replaced by surrogates.

    E-mail and IP addresses, phone, card and person numbers, secrets (long hexadecimal strings)
    and names (after a title, also in capitals, or a known given name with a surname). `key`, a
    secret string, decides all surrogates: those of two keys have nothing in common. Mentions of an entity get
    the same surrogate in all rows, different entities different ones, and no surrogate is an
    entity of the table. Layout, letter case, script, titles and country codes stay; given names keep
    their gender, or take that of the title, valid card numbers stay valid. Other text is untouched. NULL texts stay NULL and empty ones
    empty. Each row comes back once, repeated rows and ids too.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")).alias("row"),
    )
    found = named.select("row", F.explode(mentions(F.col("text"))).alias("m")).select("row", "m.kind", "m.entity")
    found = keep(found.distinct(), "pii-mentions")
    turns = keep(later_turns(found, key), "pii-turns")
    # Documents with an entity whose first surrogate was taken: few rows, and a written table.
    special = found.join(turns, ["kind", "entity"]).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "entity"), "turn"))).alias("turns")
    )
    special = keep(special, "pii-special").withColumnRenamed("row", "special_row")
    joined = named.join(special, F.col("row") == F.col("special_row"), "left")

    def rewrite(found):
        def turn(m):
            return F.coalesce(F.try_element_at("turns", F.concat_ws(":", m["kind"], m["entity"])), F.lit(0))

        pieces = F.split("text", ENTITY, -1)
        replaced = _interleave(pieces, F.transform(found, lambda m: _replacement(m, turn(m), key)))
        return F.struct(
            F.when(F.size(found) > 0, replaced).otherwise(F.col("text")).alias("text"),
            F.coalesce(F.size(found), F.lit(0)).alias("n_replaced"),
        )

    return joined.select("doc_id", let(mentions(F.col("text")), rewrite).alias("r")).select(
        "doc_id", "r.text", F.when(F.col("r.n_replaced") > 0, F.col("r.n_replaced")).otherwise(0).alias("n_replaced")
    )
