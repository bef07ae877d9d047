"""Personal data and secrets replaced by surrogates of the same kind, with native columns only.

A surrogate is a keyed hash of what it replaces, written in the same form: digits for digits, the same country code and
Luhn validity, names of the same gender and script. It depends on nothing else, so an entity has one surrogate wherever it
stands. Over all rows it is checked that no two entities get the same surrogate and that none is another entity of the
corpus; the few that fail take the next surrogate in their row of attempts, and only these are looked up. Where a form has
too few values for its entities, later attempts are longer or from another block of addresses, so there is always a free one.
"""

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.frames import ROW, tidy, with_row_ids
from tidegauge.plans.spread import settle, sized_join

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
MALE = r"Mr|Herr|Sr|Señor|Monsieur|г-н|господин"
FEMALE = r"Mrs|Ms|Miss|Frau|Sra|Señora|Mme|Madame|г-жа|госпожа"
_TITLE = rf"(?:{MALE}|{FEMALE})\.? "
_PARTICLE = (r"(?:v[ao]n|vom|zu[mr]?|de[lnrs]?|della|di|d[aou]s?|l[aeo]s?|te[nr]|af|av|bin|ibn|ben|al|el|y|e|i)")
_INITIAL = r"\p{Lu}\."
#: A word of a name, without the 's of a possessive.
_NAME = (rf"(?!(?:{MALE}|{FEMALE})(?!\p{{L}}))(?:(?:d|l|dell|al|el)['’-])?\p{{Lu}}"
         r"(?:\p{L}|(?!['’]s(?!\p{L}))['’-](?=\p{L}))++")
#: Given names and initials, particles, and the surname: all name words that follow a title.
_PERSON = rf"(?:(?:{_PARTICLE}|{_INITIAL}) )*+{_NAME}(?:(?: (?:{_PARTICLE}|{_INITIAL}))*+ {_NAME})*+"

#: Kinds in order of preference, and how each is written.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": _EDGE + r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,})" + _END,
    "ip": _EDGE + r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?:(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}"
             r"|(?<![\p{L}\p{N}-])\d{3}[.-]\d{3}[.-]\d{4})" + _END,
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": _EDGE + r"\d(?:[ -]?\d){12,18}" + _END,
    "man": _EDGE + rf"(?:{MALE})\.? {_PERSON}",
    "woman": _EDGE + rf"(?:{FEMALE})\.? {_PERSON}",
}
ANY = "|".join(KINDS.values())
#: What every match contains, so that most texts need no more than one look: a digit, an at sign, or a known beginning.
QUICK = (r"[@0-9]|AKIA|gh[pousr]_|[MHSFг](?:r|rs|s|iss|me|onsieur|adame|err|ra|eñora?|rau|-н|-жа|осподин|оспожа)\.? \p{L}")
#: Attempts in the form of the entity itself; each one after them is a digit longer, or in a wider block of addresses.
SAME_FORM = 4
_CYRILLIC = ("abcdefghijklmnoprstuvz", "абцдефгхийклмнопрстувз")
_SOUNDS = ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "dr")
_VOWELS = ("a", "e", "i", "o")


def _pool(key: str, kind: Column, norm: Column, attempt: Column, length: Column) -> Column:
    """Hex digits of a keyed hash, two for each of ``length`` characters."""
    block = lambda i: F.sha2(F.concat_ws("\u0001", F.lit(key), kind, norm, attempt.cast("string"), i.cast("string")), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int")), block), "")


def _value(pool: Column, i: Column) -> Column:
    return F.conv(F.substring(pool, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shaped(text: Column, pool: Column) -> Column:
    """Digits for digits and letters for letters of the same case and script, from the pool; hex letters stay hex."""
    hexa = text.rlike("^[0-9a-fA-F]{32,}$")

    def one(c, i):
        v = _value(pool, i)
        letters = F.when(hexa, F.lit(6)).otherwise(F.lit(26))
        return (F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.char(v % letters + 97))
                .when(c.rlike("[A-Z]"), F.char(v % letters + 65))
                .when(c.rlike(r"\p{IsCyrillic}"), F.substring(F.lit(_CYRILLIC[1]), v % 22 + 1, F.lit(1)))
                .when(c.rlike(r"\p{L}"), F.char(v % 26 + 97)).otherwise(c))

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the right; with ``doubled_first`` as if a check digit followed."""
    def add(total, x):
        d = x["d"] * F.when(x["i"] % 2 == (0 if doubled_first else 1), 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)
    back = F.transform(_chars(F.reverse(digits)), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(back, F.lit(0), add) % 10


def _name(pool: Column, gender: Column, script: Column, attempt: Column) -> Column:
    """A pronounceable name; more attempts make longer names, so there is always a free one."""
    pick = lambda options, i: F.element_at(F.array(*map(F.lit, options)), _value(pool, F.lit(i)) % len(options) + 1)
    parts = [pick(_SOUNDS if i % 2 == 0 else _VOWELS, i) for i in range(4)]
    more = F.when(attempt > 0, F.concat(pick(_SOUNDS, 4), pick(_VOWELS, 5), F.substring(pool, 13, F.least(attempt, F.lit(40)))))
    more = F.translate(F.coalesce(more, F.lit("")), "0123456789cx", "aeioulmnrstk")
    end = F.when(gender == "f", pick(("na", "la", "ria", "sa"), 6)).when(gender == "m", pick(("n", "r", "ko", "s"), 6)).otherwise(
        pick(("man", "ton", "ver", "nov"), 6))
    name = F.concat(*parts, more, end)
    return F.when(script == "cyrillic", F.translate(name, *_CYRILLIC)).otherwise(name)


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value written and computed once."""
    return F.transform(F.array(value), then)[0]


def _growth(attempt: Column) -> Column:
    return F.greatest(attempt - (SAME_FORM - 1), F.lit(0))


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate of a normal form, as a normal form."""
    return _let(_pool(key, kind, norm, attempt, F.length(norm) + _growth(attempt)), lambda pool: _from_pool(key, kind, norm, attempt, pool))


def _from_pool(key, kind, norm, attempt, pool):
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    host = F.substring(F.sha2(F.concat(F.lit(key), F.lit("\u0001host\u0001"), domain), 256), 1, 8)
    octet = [(_value(pool, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]
    small, private = norm.startswith("192.168."), norm.rlike(r"^(?:10|192\.168)\.")
    first2 = (F.when(small & (attempt < SAME_FORM), F.lit("192.168"))
              .when(private & (attempt < 3 * SAME_FORM), F.concat(F.lit("10."), octet[1]))
              .otherwise(F.concat_ws(".", (_value(pool, F.lit(0)) % 190 + 20).cast("string"), octet[1])))
    # The addresses of the fourth version may all be in use; those set apart for documentation in the sixth are not.
    sixth = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(pool, 4 * i + 1, 4)) for i in range(6)])
    address = F.when(attempt < 6 * SAME_FORM, F.concat_ws(".", first2, octet[2], octet[3])).otherwise(sixth)
    # What is kept of a phone number is its country code, and of a secret its known beginning; an e-mail keeps its form only.
    kept = F.regexp_extract(norm, r"^(?:\+\d{1,3} |AKIA|gh[pousr]_)?", 0)
    rest = F.when(kind == "email", local).otherwise(F.substring(norm, F.length(kept) + 1, F.length(norm)))
    longer = F.when(attempt < SAME_FORM, "").otherwise(F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(_growth(attempt), F.lit(1))), lambda i: (_value(pool, F.length(norm) + i - 1) % 10).cast("string")), ""))
    shaped = F.concat(kept, _shaped(rest, pool), longer)

    def card(digits):
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        valid = F.concat(body, ((F.lit(10) - _luhn(body, True)) % 10).cast("string"))
        return F.when(_luhn(norm, False) == 0, valid).otherwise(digits)

    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(kind == "given_m", "m").when(kind == "given_f", "f").otherwise("")
    return (F.when(kind == "ip", address)
            .when(kind.isin("given_m", "given_f", "surname"), _name(pool, gender, script, attempt))
            .otherwise(_let(shaped, lambda new: F.when(kind == "email", F.concat(new, F.lit("@h"), host, F.lit(".example.net")))
                            .when(kind == "card", card(new)).otherwise(new))))


def _kind_of(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _words(match: Column) -> Column:
    """The words of a person behind the title, if there is one."""
    return F.split(F.regexp_replace(match, f"^{_TITLE}", ""), " ")


def _part(kind: Column | str, norm: Column, word: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"), word.alias("word"))


def _parts(kind: Column, match: Column) -> Column:
    """The entities of a match as (kind, norm, word): itself, or the words of a person, of which particles are no entities."""
    country = F.regexp_extract(match, r"^\+(\d{1,3})(?=[ .(-])", 1)
    numbers = F.when(country != "", F.concat(F.lit("+"), country, F.lit(" "), _digits(F.regexp_replace(match, r"^\+\d{1,3}", "")))
                     ).otherwise(_digits(match))
    norm = (F.when(kind == "email", F.lower(match)).when(kind == "phone", numbers).when(kind.isin("card", "ssn"), _digits(match))
            .otherwise(match))

    def person(words):
        def part(w, i):
            # A Russian woman's surname is a man's with an ending, and so is its surrogate.
            last = F.regexp_replace(F.lower(w), r"(?<=[овин])а$", "")
            given = F.when(kind == "woman", "given_f").otherwise("given_m")
            return (F.when(w.rlike(f"^{_PARTICLE}$"), _part("particle", w, w))
                    .when(i == F.size(words) - 1, _part("surname", last, w)).otherwise(_part(given, F.lower(w), w)))
        return F.transform(words, part)

    return F.when(kind.isin("man", "woman"), _let(_words(match), person)).otherwise(F.array(_part(kind, norm, match)))


def _names(matches: Column) -> Column:
    """(kind, norm, word, of) of the name words of a text's titled persons; ``of`` is man or woman."""
    persons = F.filter(matches, lambda m: m["kind"].isin("man", "woman"))
    return F.array_distinct(F.flatten(F.transform(persons, lambda m: F.transform(
        F.filter(m["parts"], lambda p: p["kind"] != "particle"),
        lambda p: F.struct(p["kind"].alias("kind"), p["norm"].alias("norm"), p["word"].alias("word"), m["kind"].alias("of"))))))


def _any_or(names: Column) -> Column:
    """ANY, or some of the names, as they are written or all or only the first letter in upper case. Null without names."""
    full = F.filter(names, lambda n: ~n["word"].rlike(f"^{_INITIAL}$"))
    forms = F.array_distinct(F.flatten(F.transform(full, lambda n: F.array(n["word"], F.upper(n["word"]), F.concat(
        F.upper(F.substring(n["word"], 1, 1)), F.lower(F.substring(n["word"], F.lit(2), F.length(n["word"]))))))))
    name = F.concat(F.lit("(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}]|[\p{L}\p{N}._%+-]*+@)"))
    return F.when(F.size(forms) > 0, F.concat(
        F.lit(f"{ANY}|{_EDGE}"), name, F.lit(f"(?:(?: (?:{_PARTICLE}|{_INITIAL}))*+ "), name, F.lit(")*+")))


def _untitled(match: Column, names: Column) -> Column:
    """A mention without a title: each word is what it is in the text's titled persons, the last one a surname if it can be."""
    def part(w, i, words):
        same = F.filter(names, lambda n: F.upper(n["word"]) == F.upper(w))
        best = F.filter(same, lambda n: (n["kind"] == "surname") == (i == F.size(words) - 1))
        return _let(F.coalesce(F.get(best, F.lit(0)), F.get(same, F.lit(0))), lambda n: F.when(
            n.isNull(), _part("particle", w, w)).otherwise(_part(n["kind"], n["norm"], w)))

    def whole(words):
        of = F.get(F.filter(names, lambda n: F.upper(n["word"]) == F.upper(F.element_at(words, -1))), F.lit(0))["of"]
        return F.struct(match.alias("match"), F.coalesce(of, F.lit("man")).alias("kind"),
                        F.transform(words, lambda w, i: part(w, i, words)).alias("parts"))

    return _let(F.split(match, " "), whole)


def _matches(text: Column) -> Column:
    """``found``, (match, kind, parts) in order of their places, and ``own``, the pattern of texts that name persons.

    Persons are found behind their titles first. A text that has some is looked through again, for their names alone too.
    """
    def titled(m):
        return _let(_kind_of(m), lambda k: F.struct(m.alias("match"), k.alias("kind"), _parts(k, m).alias("parts")))

    def again(first, names, own):
        every = F.transform(F.regexp_extract_all(text, F.concat(F.lit("("), own, F.lit(")")), F.lit(1)), lambda m: _let(
            _kind_of(m), lambda k: F.when(k.isNull(), _untitled(m, names)).otherwise(
                F.struct(m.alias("match"), k.alias("kind"), _parts(k, m).alias("parts")))))
        return F.struct(F.when(own.isNull(), first).otherwise(every).alias("found"), own.alias("own"))

    found = F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    found = F.transform(F.coalesce(found, F.array().cast("array<string>")), titled)
    return _let(found, lambda first: _let(_names(first), lambda names: _let(_any_or(names), lambda own: again(first, names, own))))


def _cased(core: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.lower(like) != like) & (F.length(like) > 1), F.upper(core)).otherwise(
        F.when(like.rlike(r"^\p{Lu}"), F.initcap(core)).otherwise(core))


def _rendered(m: Column, core) -> Column:
    """The surrogate in the form of the match. ``core(part)`` gives the normal form of a part's surrogate."""
    match, kind = m["match"], m["kind"]
    # A person's title, and a phone number's country code, stand as they are.
    fixed = F.when(kind.isin("man", "woman"), F.regexp_extract(match, f"^{_TITLE}", 0)).when(
        kind == "phone", F.regexp_extract(match, r"^\+\d{1,3}(?=[ .(-])", 0)).otherwise("")

    def number(new, tail):
        place = lambda i: F.length(_digits(F.substring(tail, F.lit(1), i + 1)))
        fresh = _digits(F.regexp_replace(new, r"^\+\d{1,3} ", ""))
        # Digits of a longer surrogate follow the last place.
        return _let(fresh, lambda digits: F.concat(F.array_join(F.transform(_chars(tail), lambda c, i: F.when(
            c.rlike(r"\d"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), ""),
            F.substring(digits, F.length(_digits(tail)) + 1, F.length(digits))))

    def word(p):
        female = (kind == "woman") & (p["kind"] == "surname") & p["word"].rlike(r"(?<=[овинОВИН])[аА]$")
        ending = F.when(female, F.lit("а")).otherwise(F.lit(""))
        return _let(core(p), lambda new: F.when(p["word"].rlike(f"^{_INITIAL}$"), F.concat(F.upper(F.substring(new, 1, 1)), F.lit("."))
                                                ).otherwise(_cased(F.concat(new, ending), p["word"])))

    def person():
        return F.array_join(F.transform(m["parts"], lambda p: F.when(p["kind"] == "particle", p["word"]).otherwise(word(p))), " ")

    def whole(new):
        tail = F.substring(match, F.length(fixed) + 1, F.length(match))
        return (F.when(kind.isin("phone", "card", "ssn"), F.concat(fixed, number(new, tail)))
                .when((kind == "email") & (F.upper(match) == match), F.upper(new)).otherwise(new))

    return F.when(kind.isin("man", "woman"), F.concat(fixed, person())).otherwise(_let(core(m["parts"][0]), whole))


def later_attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate is taken: by another entity or by one of the corpus.

    ``entities`` has distinct (kind, norm). Of those that claim one surrogate the least hash gets it. Rounds go on until
    none is left; each handles a small part of the one before. They end, as the room of a form grows with the attempts.
    """
    def claim(df, attempt):
        return df.select("kind", "norm", surrogate(key, F.col("kind"), F.col("norm"), F.lit(attempt)).alias("new"))

    own = entities.select("kind", F.col("norm").alias("new"))
    taken, settled, pending = None, None, entities
    for attempt in itertools.count():
        claims = settle(claim(pending, attempt))
        free = claims.join(own, ["kind", "new"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "new"], "left_anti")
        won = settle(free.groupBy("kind", "new").agg(F.min_by("norm", F.xxhash64("norm")).alias("norm")))
        if attempt:
            got = won.select("kind", "norm", F.lit(attempt).alias("attempt"))
            settled = got if settled is None else settled.unionByName(got)
        pending = settle(claims.select("kind", "norm").join(won, ["kind", "norm"], "left_anti"))
        if not pending.limit(1).count():
            return settled if settled is not None else entities.select("kind", "norm", F.lit(0).alias("attempt")).limit(0)
        taken = won.select("kind", "new") if taken is None else taken.unionByName(won.select("kind", "new"))


def replace(docs: DataFrame, key: str, text_col="text", id_col="doc_id") -> DataFrame:
    """``docs`` with the text rewritten, and n_entities (long) and kinds (sorted array of the kinds found) added.

    Kinds: e-mail addresses, secrets (long hex strings, known key forms), IPv4 addresses, phone numbers, social security
    numbers, card numbers, and persons behind a title that shows their gender. Such a person has all the capitalised words
    and initials that follow, across particles, which stay: the last is the surname, the others are given names. Each is an
    entity of its own, so "Mr John Smith" and "Mr Smith" stay one person. Where a text names a person behind a title, the same
    names without one, alone or in a row, are replaced in that text too; persons that never have a title are not found. Upper and lower case and the separators
    of numbers do not tell entities apart, and are kept where they stand. The same key gives the same surrogates.

    Null texts stay null and have no entities; rows may repeat. Columns of the added names give way. Distinct entities are
    counted up before they are shuffled, so one that stands everywhere is one row per task.
    """
    docs, _ = with_row_ids(tidy(docs, [text_col, id_col], ["n_entities", "kinds"]), id_col)
    found = docs.select(F.col(ROW), _matches(F.col(f"`{text_col}`"))["found"].alias("m"))
    mentions = found.filter(F.size("m") > 0).select(F.col(ROW), F.explode(F.flatten(F.transform("m", lambda m: m["parts"]))).alias("e"))
    mentions = mentions.select(ROW, "e.kind", "e.norm").filter("kind <> 'particle'")
    later = settle(later_attempts(settle(mentions.select("kind", "norm").distinct()), key))
    own = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    out = docs.select(*[F.col(f"`{c}`") for c in own])
    tries = F.lit(None).cast("map<string,int>")
    if later.limit(1).count():
        hit = sized_join(mentions.distinct(), later, ["kind", "norm"], [ROW], "inner")
        maps = hit.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct(
            F.concat_ws("\u0001", "kind", "norm"), "attempt"))).alias("__tries"))
        out, tries = out.join(maps, ROW, "left"), F.col("__tries")

    def core(part):
        attempt = F.coalesce(F.try_element_at(tries, F.concat_ws("\u0001", part["kind"], part["norm"])), F.lit(0))
        return surrogate(key, part["kind"], part["norm"], attempt)

    text = F.col(f"`{text_col}`")
    out = out.withColumn("__f", _matches(text)).withColumns({"__m": F.col("__f.found"), "__own": F.col("__f.own")})
    between = F.when(F.col("__own").isNull(), F.split(text, ANY, -1)).otherwise(F.split(text, F.col("__own"), -1))
    fresh = F.concat(F.transform("__m", lambda m: _rendered(m, core)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, fresh, lambda a, b: F.concat(a, b)), "")
    kinds = F.array_sort(F.array_distinct(F.transform("__m", lambda m: m["kind"])))
    rewritten = F.when(F.size("__m") > 0, joined).otherwise(text)
    return out.select(*[rewritten.alias(c) if c == text_col else F.col(f"`{c}`") for c in own if c != ROW],
                      F.size("__m").cast("long").alias("n_entities"), kinds.alias("kinds"))
