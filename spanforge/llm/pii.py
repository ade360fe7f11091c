"""Personal data replaced by keyed surrogates.

Entities are found with one pattern of alternatives: e-mail addresses, IP addresses of
both versions, card numbers, phone numbers, social security numbers, account numbers
(IBAN, spaced or not), keyed tokens of known prefixes, long hexadecimal secrets, and names
behind a form of address or an introduction.  Numbers of 13 to 19 digits are cards only if
their check digit is right and their first digit is an issuer's, and accounts only if
their check number is; whatever fails stays as it is.  The pattern has no groups that
repeat by recursion and every alternative is anchored or bounded, so long runs of any sign
cost time in proportion to their length and no stack.

Each entity gets a surrogate of its own type, made from the key and the entity alone,
so the same entity has the same surrogate wherever it stands, whatever else is in the corpus.

  numbers     the digits go through a keyed Feistel permutation of all digit strings of their
              length; signs, spaces and a leading country code stay as they are
  cards       the same between the first and the last digit; the check digit is worked out
  accounts    the same for the digits and for the letters of the account; the country stays,
              the check number is worked out
  IP          the same over the 32 bits of an address, or over the hexadecimal digits of one of version 6
  tokens      keyed signs of the same classes behind the prefix
  secrets     keyed hexadecimal digits, as many and of the same case
  e-mail      a keyed local part at a keyed host of a reserved domain
  names       each surname and each given name has its own keyed one, in its script, given names
              of the gender that the form of address tells; the form of address stays

Permutations can't collide.  The other parts (e-mails, tokens, secrets, given names, surnames) are
checked: all distinct ones are written once with their surrogates, and of those that share one
all but the first get a longer one, until none do.  A surname has 50 bits, a given name 34,
an e-mail 66 and more, a token 80, a secret 128, so n distinct ones make about n * n / 2 ** 51 collisions
at most but for given names; only those come to the driver.  DataFrame functions only.

Defined cases: a null text stays null and has no entities; an empty text stays empty;
overlapping candidates are taken from the left; repeated rows are replaced row by row.
Only doc_id and text are read, besides the columns asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Forms of address by the gender that they tell.
ADDRESS = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία"),
    "n": ("Dr", "Prof"),
}
#: Given names by script and gender, and syllables of surnames by script.
GIVEN = {
    ("latin", "m"): (
        "Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"
    ),
    ("latin", "f"): (
        "Alice", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"
    ),
    ("latin", "n"): (
        "Alex", "Andrea", "Charlie", "Chris", "Dominique", "Eli", "Jamie", "Jordan", "Kim", "Lou", "Maxime", "Noa", "Robin", "Sam", "Sascha", "Toni"
    ),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Максим", "Павел"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава"),
    ("greek", "m"): ("Αλέξης", "Γιάννης", "Κώστας", "Νίκος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "n"): ("Αλέξης", "Άγγελος", "Άρης", "Χάρης"),
}
#: Sounds by script; a syllable is one of each list.
SYLLABLES = {
    "latin": ("b d f g h j k l m n p r s t v w".split(), "a e i o u".split(), "b d f g k l m n p r s t v x z sk".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т х ч".split(), "а е и о у".split(), "б в г д к л м н п р с т ф х ш в".split()),
    "greek": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ".split(), "α ε ι ο υ".split(), "β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ".split()),
}
_TITLES = "|".join(sorted((t for ts in ADDRESS.values() for t in ts), key=len, reverse=True))
_NAME = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
#: Words that a name without a form of address comes after, and that a bare phone number does; they are part of the find.
_INTRODUCED = r"[Nn]ame is|[Nn]ame:|[Ss]igned by|[Cc]ontact:"
_CALLED = r"(?:[Tt]elephone|[Tt]el|[Pp]hone|[Cc]all|[Mm]obile|[Ff]ax|[Cc]ell)[.:]{0,2} {0,2}"
_H = "[0-9a-fA-F]{1,4}"

#: Patterns by type, in the order in which they are tried, none of them inside a word.
#: Quantifiers of groups are possessive or bounded.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "token": r"(?<![_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|xox[abprs]-[0-9A-Za-z-]{20,255}|sk-[0-9A-Za-z_-]{20,255}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])",
    "ip6": rf"(?<![:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{2,6}}(?::{_H}){{1,5}}|{_H}:(?::{_H}){{2,6}}|(?:fe80|2[0-9a-fA-F]{{3}})::{_H})(?![0-9A-Za-z:])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9A-Za-z])(?!\.[0-9])",
    "secret": r"[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [0-9A-Z]?[0-9]{1,2})?)(?![0-9A-Za-z])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    rf"|{_CALLED}[0-9]{{7,12}})(?![0-9A-Za-z])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "person": rf"(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|(?:{_INTRODUCED}) {_NAME} {_NAME})",
}
#: At the start of an entity: no sign of a word before it, and one that some pattern begins with.
START = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}._%+(-])"
ANY = f"{START}(?:" + "|".join(PATTERNS.values()) + ")"
#: Every entity has a digit, an @, one of these words, or nothing but letters of hexadecimal digits; other texts aren't searched.
HINTS = ("::", "AKIA", "ASIA", "AIza", "sk-", "xox", "gh", "ame is ", "ame: ", "igned by ", "ontact: ", *(t for ts in ADDRESS.values() for t in ts))
BARE_SECRET = r"(?<![0-9A-Za-z])[a-fA-F]{32}"
ROUNDS = 4
#: Letters of an e-mail's local part, syllables of a surname, and of what follows a given name; a further attempt adds one.
LENGTHS = {"email": 12, "family": 5, "given": 3}
SEPARATOR = "\x1f"
LETTERS, ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOP"


def let(value: Column, body) -> Column:
    """body over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mod97(signs: Column) -> Column:
    """The remainder by 97 of a number written in digits and letters, where A is 10 and Z is 35."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(
        F.split(signs, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(
            F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97))
        )
    )


def kind(e: Column) -> Column:
    """An entity's type; null for what only looks like one."""
    digits = F.regexp_replace(e, "[ -]", "")
    account = F.replace(e, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|AIza)"), "token")
        .when(e.contains(":"), "ip6")
        .when(e.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(e.rlike(r"^[0-9a-fA-F]{32,}+$"), "secret")
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), F.when(mod97(moved) == 1, "iban"))
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(e.rlike(rf"^[+(]|^[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$|^{_CALLED}[0-9]"), "phone")
        .when(e.rlike(r"^[0-9]"), F.when(F.call_function("luhn_check", digits) & digits.rlike("^[2-6]"), "card"))
        .otherwise("person")
    )


class Surrogates:
    """Expressions that replace entities; all of them depend on the key and the entity alone."""

    def __init__(self, key: str, lengths: dict[str, int] | None = None, attempts: dict[tuple[str, str], int] | None = None):
        self.key, self.lengths, self.attempts = key, {**LENGTHS, **(lengths or {})}, attempts or {}

    def digest(self, *parts: Column) -> Column:
        """64 hexadecimal digits."""
        return F.sha2(F.concat_ws(SEPARATOR, F.lit(self.key), *parts), 256)

    def number(self, digest: Column, start, size: int = 12) -> Column:
        return F.conv(F.substring(digest, start, size), 16, 10).cast("long")

    def attempt(self, of: Column, atom: Column) -> Column:
        if not self.attempts:
            return F.lit(0)
        pairs = F.create_map(*[F.lit(x) for k, n in sorted(self.attempts.items()) for x in (SEPARATOR.join(k), n)])
        return F.coalesce(pairs[F.concat_ws(SEPARATOR, of, atom)], F.lit(0))

    # permutations

    def permuted(self, digits: Column, tweak: str, base: int = 10) -> Column:
        """A keyed permutation of the digit strings of one length and base; a single digit stays."""

        def step(state: Column, r: Column) -> Column:
            # halves a and b; each round adds a keyed number of the one to the other, then they change places
            a, b = state["a"], state["b"]
            size = F.length(a)
            add = self.number(self.digest(F.lit(tweak), r.cast("string"), F.length(digits).cast("string"), b), 1)
            sum_ = F.pmod(F.conv(a, base, 10).cast("decimal(20,0)") + add, F.pow(F.lit(float(base)), size).cast("decimal(20,0)"))
            return F.struct(b.alias("a"), F.lpad(F.conv(sum_.cast("string"), 10, base), size, F.lit("0")).alias("b"))

        half = F.floor(F.length(digits) / 2).cast("int")
        first = F.struct(F.substring(digits, F.lit(1), half).alias("a"), F.substring(digits, half + 1, F.length(digits)).alias("b"))
        return F.when(F.length(digits) < 2, digits).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step, lambda s: F.concat(s["a"], s["b"]))
        )

    def relaid(self, e: Column, made: Column, signs: str) -> Column:
        """e with its signs of a class taken from `made` in turn, and everything else as it was."""
        place = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), f"[^{signs}]", ""))
        refill = lambda m: F.array_join(
            F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike(f"[{signs}]"), F.substring(m, place(i), F.lit(1))).otherwise(c)), ""
        )
        return let(made, refill)

    def refilled(self, e: Column, tweak: str) -> Column:
        """The entity with its digits permuted and everything else as it was."""
        return self.relaid(e, let(F.regexp_replace(e, "[^0-9]", ""), lambda digits: self.permuted(digits, tweak)), "0-9")

    def card(self, e: Column) -> Column:
        def made(digits: Column) -> Column:
            body = F.concat(F.substring(digits, 1, 1), let(F.substring(digits, F.lit(2), F.length(digits) - 2), lambda x: self.permuted(x, "card")))
            return let(
                body, lambda b: F.get(
                    F.filter(
                        F.transform(
                            F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(b, d.cast("string"))
                        ), lambda x: F.call_function("luhn_check", x)
                    ),
                    F.lit(0),
                )
            )

        return self.relaid(e, let(F.regexp_replace(e, "[^0-9]", ""), made), "0-9")

    def iban(self, e: Column) -> Column:
        def made(account: Column) -> Column:
            land, rest = F.substring(account, 1, 2), F.substring(account, F.lit(5), F.length(account))

            def checked(new: Column) -> Column:
                return F.concat(land, F.lpad((F.lit(98) - mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0"), new)

            letters = F.translate(F.regexp_replace(rest, "[^A-Z]", ""), LETTERS, ALPHABET)
            lettered = self.relaid(rest, F.translate(let(letters, lambda x: self.permuted(x, "account letters", 26)), ALPHABET, LETTERS), "A-Z")
            return let(lettered, lambda x: let(self.refilled(x, "account"), checked))

        return self.relaid(e, let(F.replace(e, F.lit(" "), F.lit("")), made), "0-9A-Z")

    def ip(self, e: Column) -> Column:
        def step(state: Column, r: Column) -> Column:
            mixed = self.number(self.digest(F.lit("ip"), r.cast("string"), state["b"].cast("string")), 1).bitwiseAND(0xFFFF).cast("int")
            return F.struct(state["b"].alias("a"), state["a"].bitwiseXOR(mixed).alias("b"))

        def made(o: Column) -> Column:
            first = F.struct((o[0] * 256 + o[1]).alias("a"), (o[2] * 256 + o[3]).alias("b"))
            octets = lambda h: (F.shiftright(h, 8), h.bitwiseAND(255))
            return F.aggregate(
                F.sequence(F.lit(1), F.lit(ROUNDS)), first, step, lambda s: F.concat_ws(
                    ".", *[x.cast("string") for h in (s["a"], s["b"]) for x in octets(h)]
                )
            )

        return let(F.transform(F.split(e, r"\."), lambda x: x.cast("int")), made)

    def ip6(self, e: Column) -> Column:
        digits = F.lower(F.regexp_replace(e, "[^0-9a-fA-F]", ""))
        return self.relaid(e, let(digits, lambda x: F.lower(self.permuted(x, "ip6", 16))), "0-9a-fA-F")

    # parts that are checked for collisions

    def stream(self, of: str, atom: Column, length: Column) -> Column:
        """Keyed hexadecimal digits, as many."""
        n = self.attempt(F.lit(of), atom).cast("string")
        many = F.transform(F.sequence(F.lit(1), F.ceil(length / 64).cast("int")), lambda i: self.digest(F.lit(of), atom, i.cast("string"), n))
        return F.substring(F.array_join(many, ""), F.lit(1), length)

    def secret(self, atom: Column) -> Column:
        return self.stream("secret", atom, F.length(atom))

    def token(self, atom: Column) -> Column:
        prefix = F.regexp_extract(atom, r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|AIza)", 0)

        def made(x: Column) -> Column:
            def sign(c: Column, i: Column) -> Column:
                n = self.number(x["s"], 3 * i + 1, 3)
                return F.when(
                    c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")
                ).when(c.rlike("[A-Z]"), F.char(65 + F.pmod(n, F.lit(26)))).when(c.rlike("[a-z]"), F.char(97 + F.pmod(n, F.lit(26)))).otherwise(c)

            return F.concat(x["p"], F.array_join(F.transform(F.split(x["rest"], ""), sign), ""))

        rest = F.substring(atom, F.length(prefix) + 1, F.length(atom))
        return let(F.struct(prefix.alias("p"), rest.alias("rest"), self.stream("token", atom, F.length(atom) * 3).alias("s")), made)

    def email(self, atom: Column) -> Column:
        def made(d: Column) -> Column:
            letters = F.transform(
                F.sequence(
                    F.lit(0), self.size("email", F.lit("email"), atom, 17) - 1
                ), lambda i: F.char(97 + F.pmod(self.number(d, 1 + 3 * i, 3), F.lit(26)))
            )
            return F.concat(
                F.array_join(letters, ""), F.lit("@host"), F.pmod(self.number(d, 55, 6), F.lit(1000)).cast("string"), F.lit(".example.org")
            )

        return let(self.digest(F.lit("email"), atom, self.attempt(F.lit("email"), atom).cast("string")), made)

    def size(self, what: str, of: Column, atom: Column, most: int) -> Column:
        return F.least(self.attempt(of, atom) + self.lengths[what], F.lit(most))

    def syllables(self, d: Column, script: Column, n: Column) -> Column:
        """n syllables from the digits 2, 3, ... of a digest, the first letter in upper case."""
        lists = [F.create_map(*[x for k, v in SYLLABLES.items() for x in (F.lit(k), F.array(*map(F.lit, v[j])))]) for j in range(3)]
        sound = lambda j, i: F.get(lists[j][script], F.pmod(self.number(d, 2 + 3 * i + j, 1), F.size(lists[j][script])).cast("int"))
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(*[sound(j, i) for j in range(3)])), ""))

    def family(self, script: Column, atom: Column) -> Column:
        of = F.concat_ws("-", F.lit("family"), script)
        return let(
            self.digest(of, atom, self.attempt(of, atom).cast("string")), lambda d: self.syllables(d, script, self.size("family", of, atom, 20))
        )

    def given(self, script: Column, gender: Column, atom: Column) -> Column:
        of = F.concat_ws("-", F.lit("given"), script, gender)
        names = F.create_map(*[x for k, v in GIVEN.items() for x in (F.lit("-".join(k)), F.array(*map(F.lit, v)))])[F.concat_ws("-", script, gender)]

        def made(d: Column) -> Column:
            return F.concat_ws(
                "-",
                F.get(names, F.pmod(self.number(d, 1, 1), F.size(names)).cast("int")),
                self.syllables(d, script, self.size("given", of, atom, 20)),
            )

        return let(self.digest(of, atom, self.attempt(of, atom).cast("string")), made)

    def person(self, e: Column) -> Column:
        def made(x: Column) -> Column:
            family = let(F.lower(F.element_at(x["words"], -1)), lambda a: self.family(x["script"], a))
            given = F.when(F.size(x["words"]) > 1, let(F.lower(x["words"][0]), lambda a: self.given(x["script"], x["gender"], a)))
            return F.concat_ws(" ", x["title"], given, family)

        return let(told(e), made)

    def atom(self, of: Column, atom: Column) -> Column:
        """The surrogate of a part that collisions are checked for."""
        words = F.split(of, "-")
        return (
            F.when(of == "email", self.email(atom))
            .when(of == "secret", self.secret(atom))
            .when(of == "token", self.token(atom))
            .when(words[0] == "family", self.family(F.get(words, F.lit(1)), atom))
            .otherwise(self.given(F.get(words, F.lit(1)), F.get(words, F.lit(2)), atom))
        )

    def replace(self, e: Column) -> Column:
        cased = lambda made: F.when((e == F.upper(e)) & e.rlike("[A-Z]"), F.upper(made)).otherwise(made)
        code = F.regexp_extract(e, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
        phone = let(code, lambda c: F.concat(c, let(F.substring(e, F.length(c) + 1, F.length(e)), lambda rest: self.refilled(rest, "phone"))))
        return let(
            kind(e),
            lambda k: F.when(k == "email", cased(self.email(F.lower(e))))
            .when(k == "token", self.token(e))
            .when(k == "ip6", self.ip6(e))
            .when(k == "ip", self.ip(e))
            .when(k == "secret", cased(self.secret(F.lower(e))))
            .when(k == "iban", self.iban(e))
            .when(k == "phone", phone)
            .when(k == "card", self.card(e))
            .when(k == "ssn", self.refilled(e, "ssn"))
            .when(k == "person", self.person(e))
            .otherwise(e),
        )


def told(e: Column) -> Column:
    """(title, words, gender, script) of a name, its form of address null if it has none."""
    title = F.regexp_extract(e, rf"^(?:(?:{_TITLES})\.?|{_INTRODUCED})(?= )", 0)

    def parts(t: Column) -> Column:
        bare = F.regexp_replace(t, r"\.", "")
        words = F.split(F.ltrim(F.substring(e, F.length(t) + 1, F.length(e))), " ")
        gender = F.when(bare.isin(*ADDRESS["m"]), "m").when(bare.isin(*ADDRESS["f"]), "f").otherwise("n")
        script = F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").when(e.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        return F.struct(F.when(t != "", t).alias("title"), words.alias("words"), gender.alias("gender"), script.alias("script"))

    return let(title, parts)


def candidates(text: Column) -> Column:
    """What the pattern finds in a text, from left to right."""
    hinted = text.rlike("[0-9@]")
    for word in HINTS:
        hinted = hinted | text.contains(word)
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)
    return F.when(hinted | text.rlike(BARE_SECRET), found).otherwise(F.array().cast("array<string>"))


def entities(text: Column) -> Column:
    """The entities of a text, from left to right."""
    return F.filter(candidates(text), lambda e: kind(e).isNotNull())


def atoms(e: Column) -> Column:
    """The parts of an entity that have surrogates of their own and might collide: (of, atom)."""
    part = lambda of, atom: F.struct(of.alias("of"), atom.alias("atom"))
    one = lambda of, atom: F.array(part(F.lit(of), atom))

    def names(x: Column) -> Column:
        family = part(F.concat_ws("-", F.lit("family"), x["script"]), F.lower(F.element_at(x["words"], -1)))
        given = part(F.concat_ws("-", F.lit("given"), x["script"], x["gender"]), F.lower(x["words"][0]))
        return F.when(F.size(x["words"]) > 1, F.array(family, given)).otherwise(F.array(family))

    return let(
        kind(e),
        lambda k: F.when(k == "email", one("email", F.lower(e)))
        .when(k == "secret", one("secret", F.lower(e)))
        .when(k == "token", one("token", e))
        .when(k == "person", let(told(e), names))
        .otherwise(F.array().cast("array<struct<of:string,atom:string>>")),
    )


def settle(docs: DataFrame, key: str, lengths: dict[str, int] | None = None) -> Surrogates:
    """Surrogates under which no two different parts of one type in docs share one.

    The distinct parts are written once; a round reads only them.  Parts that collide come to
    the driver, about n * n / 2 ** 51 of n; they alone get other surrogates.
    """
    scratch = Scratch(docs.sparkSession, "entities")
    found = docs.select(F.explode(F.flatten(F.transform(candidates(F.col("text")), atoms))).alias("a")).select("a.of", "a.atom").distinct()
    found = scratch.save(found, "atoms")
    attempts: dict[tuple[str, str], int] = {}
    while True:
        made = Surrogates(key, lengths, attempts)
        named = found.withColumn("surrogate", made.atom(F.col("of"), F.col("atom")))
        kinds = F.split("of", "-")[0].alias("kind")
        clash = named.groupBy(kinds, F.lower("surrogate").alias("low")).agg(
            F.min(F.struct("of", "atom")).alias("first"), F.max(F.struct("of", "atom")).alias("last")
        ).filter("first < last")
        again = named.withColumns(
            {"kind": F.split("of", "-")[0], "low": F.lower("surrogate")}
        ).join(clash, ["kind", "low"]).filter(F.struct("of", "atom") != F.col("first")).select("of", "atom").collect()
        if not again:
            scratch.drop("atoms")
            return made
        for r in again:
            attempts[r["of"], r["atom"]] = attempts.get((r["of"], r["atom"]), 0) + 1


def _replaced(text: Column, found: Column, made: Surrogates) -> Column:
    pieces = F.zip_with(F.split(text, ANY, -1), F.transform(found, made.replace), lambda before, new: F.concat(before, F.coalesce(new, F.lit(""))))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, ""))


def replace_entities(docs: DataFrame, key: str, *others: str) -> DataFrame:
    """(doc_id, text, *others, found): texts with surrogates; found has the entities' types, in order.

    others: further columns of docs that stay, of any name but these three.
    """
    made = settle(docs, key)
    rows = docs.select(F.struct("doc_id", "text", *others).alias("row"), candidates(F.col("text")).alias("candidates"))
    text = F.when(F.col("row.text").isNotNull(), _replaced(F.col("row.text"), F.col("candidates"), made))
    found = F.filter(F.transform("candidates", kind), lambda k: k.isNotNull())
    return rows.select(F.col("row.doc_id"), text.alias("text"), *[F.col("row")[c].alias(c) for c in others], found.alias("found"))


def digest(replaced: DataFrame) -> DataFrame:
    """(doc_id, text, n_found, and how many of each type)."""
    n = lambda k: F.size(F.filter("found", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return replaced.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.size("found").cast("long").alias("n_found"), *[n(k) for k in PATTERNS]
    )
