"""Text rules as column expressions: they stay in whole-stage codegen and are null for null texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRONOUNS = ["i", "you", "he", "she", "it", "we", "they", "me", "my", "your"]
OMITTED = ["original caption", "original data", "original description", "original title"]
DIGIT_WORDS = {
    "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine",
    "10": "ten", "11": "eleven", "12": "twelve", "13": "thirteen", "14": "fourteen", "15": "fifteen", "16": "sixteen", "17": "seventeen",
    "18": "eighteen", "19": "nineteen", "20": "twenty", "30": "thirty", "40": "forty", "50": "fifty", "60": "sixty", "70": "seventy", "80": "eighty", "90": "ninety",
}
CONTRACTIONS = {
    "i'm": "i am", "you're": "you are", "he's": "he is", "she's": "she is", "it's": "it is", "we're": "we are", "they're": "they are",
    "i've": "i have", "you've": "you have", "we've": "we have", "they've": "they have", "isn't": "is not", "aren't": "are not",
    "wasn't": "was not", "weren't": "were not", "hasn't": "has not", "haven't": "have not", "hadn't": "had not", "doesn't": "does not",
    "don't": "do not", "didn't": "did not", "that's": "that is",
}
FILLERS = r"\b(uh|umm|um|er|ah)\b"
CJK = r"[\u4e00-\u9fff]"
# The class holds the letter n, so that spans with an n in them stay: the results to match have it so.
BRACKET_SPAN = r"(\[|\(|\{|<)[^()\\n\[\]]*(\]|\)|\}|>)"
CJK_SPACES = [rf"({CJK})(?={CJK})", rf"({CJK})(?=[a-zA-Z])", rf"([a-zA-Z])(?={CJK})"]


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def one_line(x: Column) -> Column:
    """Carriage returns deleted, line feeds and tabs turned into spaces."""
    return F.translate(x, "\n\t\r", "  ")


def has_bracket_pair(x: Column) -> Column:
    """Holds an opening and a closing bracket anywhere."""
    return x.rlike(r"[\[{(]") & x.rlike(r"[\]})]")


def is_bracketed(x: Column) -> Column:
    """The whole text, of one line, stands in brackets; one line feed may follow."""
    return x.rlike(r"\A[\[{(][^\n]*[\]})]\n?\z")


def has_word_character(x: Column) -> Column:
    return x.rlike(r"(?U)\w")


def replace_first(x: Column, pattern: str, by: str) -> Column:
    """Replaces only the first match."""
    return F.regexp_replace(x, rf"\A(?s)(.*?)(?:{pattern})", "$1" + by)


def unbracket_first(x: Column) -> Column:
    """Deletes the first opening and the first closing bracket."""
    return replace_first(replace_first(x, r"[\[{(]", ""), r"[\]})]", "")


def unbracket(x: Column) -> Column:
    return F.translate(x, "[]{}()", "")


def byte_length_between(x: Column, low: int, high: int) -> Column:
    return F.octet_length(x).between(low, high)


def plain_characters(x: Column) -> Column:
    """Only ASCII letters, digits, white space and punctuation of any script."""
    return x.rlike(r"\A(?:[A-Za-z0-9]|(?U:\s)|\p{P})+\z")


def strict_characters(x: Column) -> Column:
    """Only ASCII letters, digits, white space, quotes and commas."""
    return ~x.rlike(r"[^a-zA-Z0-9\s'\",]")


def no_pronoun(x: Column) -> Column:
    return ~x.rlike(r"\b(" + "|".join(PRONOUNS) + r")\b")


def tokens(x: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def word_count(x: Column) -> Column:
    return F.size(tokens(x))


def mask_names(x: Column, names: Column, by: str = "person") -> Column:
    """Tokens found in the array names are replaced; tokens are joined by one space."""
    return F.array_join(F.transform(tokens(x), lambda t: F.when(F.array_contains(names, t), by).otherwise(t)), " ")


def count_token(x: Column, token: str) -> Column:
    return F.size(F.filter(tokens(x), lambda t: t == token))


def two_tokens(x: Column) -> Column:
    """At least two parts between single spaces; empty parts count."""
    return F.size(F.split(x, " ")) >= 2


def all_in_dictionary(x: Column, dictionary: Column) -> Column:
    """Every part between single spaces, less its first punctuation mark, is in the array dictionary."""
    return F.forall(F.split(x, " "), lambda t: F.array_contains(dictionary, replace_first(t, r"\p{Punct}", "")))


def bracket_parts(x: Column) -> Column:
    """Array of the texts in brackets joined by a space, and what is left without them."""
    inside = F.array_join(F.regexp_extract_all(x, F.lit(r"[\[({]([^\[\](){}]*)[\])}]"), 1), " ")
    return F.array(inside, strip(F.regexp_replace(x, r"[\[({][^\[\](){}]*[\])}]", "")))


def contains_any(x: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | x.contains(p)
    return out


def word_set(x: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)(\w+)"), 1))


def base_name(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def stem(x: Column) -> Column:
    return F.regexp_replace(base_name(x), r"\.[^.]*\z", "")


def suffix(x: Column) -> Column:
    return F.regexp_extract(base_name(x), r"(\.[^.]*)\z", 1)


def tag(x: Column, name: str, otherwise: Column | None = None) -> Column:
    """Stripped text of the first <name>..</name>; without one the stripped text itself, or what otherwise says."""
    pattern = rf"(?s)<{name}>(.*?)</{name}>"
    return F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1))).otherwise(strip(x) if otherwise is None else otherwise)


def after_last(x: Column, mark: str) -> Column:
    return F.substring_index(x, mark, -1)


def answer_of_turn(x: Column, turn: str = "assistant\n", name: str = "answer") -> Column:
    """Of a transcript the last assistant turn, and of this what stands between the answer tags, if anything."""
    last = F.element_at(F.split(x, turn), -1)
    inner = F.try_element_at(F.split(F.try_element_at(F.split(last, f"<{name}>"), F.lit(2)), f"</{name}>"), F.lit(1))
    return strip(F.coalesce(inner, last))


def caption_of_reply(x: Column) -> Column:
    """What follows 'answer:' on its line, lower-cased; null without it."""
    low = F.lower(x)
    return F.when(low.contains("answer:"), strip(F.regexp_extract(low, r"answer:([^\n]*)", 1)))


def last_number(x: Column) -> Column:
    """The last token as a number, 0 if it is none."""
    return F.coalesce(F.try_element_at(tokens(x), F.lit(-1)).try_cast("double"), F.lit(0.0))


def has_number(x: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens(x), F.lit(-1)).try_cast("double").isNotNull(), F.lit(False)).cast("int")


def from_nth(x: Column, n: int) -> Column:
    """The text from its n-th character (1 = first): drops a choice prefix such as '(A) '."""
    return F.substring(x, n, 1 << 30)


def strip_exclamations(x: Column) -> Column:
    return F.rtrim(x, F.lit("!"))


def formatted_choice_question(x: Column) -> Column:
    """Names its choices A to D under 'Choices:'."""
    out = x.contains("Choices:")
    for c in "ABCD":
        out = out & x.contains(f"{c}. ")
    return out


def starts_with_choice(x: Column) -> Column:
    return x.rlike(r"\A[ABCD]")


def quoted_reply(x: Column) -> Column:
    """Text between the first and last quote of a reply such as: The spoken words are 'so and so'."""
    quoted = F.regexp_extract(x, r"(?s)(?:'|\")(.+)(?:'|\")", 1)
    colon = F.regexp_extract(x, r"(?s):\s*(.+)\z", 1)
    return strip(F.when(quoted != "", quoted).when(colon != "", colon).otherwise(x))


def cascade_answer(x: Column, mark: str = "Answer: ", instruction: Column | None = None) -> Column:
    """What follows the mark, up to the next one, else the reply itself. A spoken instruction, where one is given, is
    answered as it is: its reply isn't cut."""
    cut = F.when(x.contains(mark), F.substring_index(F.substring(x, F.instr(x, mark) + len(mark), F.length(x)), mark, 1)).otherwise(x)
    return cut if instruction is None else F.when(instruction, x).otherwise(cut)


def numbers_to_words(x: Column) -> Column:
    """Whole numbers to 20 and the tens as words; then contractions spelled out, each in the order of its table."""
    for k, v in DIGIT_WORDS.items():
        x = F.regexp_replace(x, rf"\b{k}\b", v)
    for k, v in CONTRACTIONS.items():
        x = F.regexp_replace(x, rf"\b{k}\b", v)
    return x


def no_fillers(x: Column) -> Column:
    return F.regexp_replace(x, FILLERS, "")


def no_bracket_spans(x: Column) -> Column:
    return F.regexp_replace(x, BRACKET_SPAN, "")


def without_phrases(x: Column, phrases: list[str]) -> Column:
    """Every phrase deleted as plain text, longer ones first, and the rest stripped: for labels that a reply spells out."""
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        x = F.replace(x, F.lit(p), F.lit(""))
    return strip(x)


def space_cjk(x: Column) -> Column:
    """A space between neighbouring ideographs, and between these and other words."""
    for pattern in CJK_SPACES:
        x = F.regexp_replace(x, pattern, "$1 ")
    return x


def letters_only(x: Column) -> Column:
    """Lower-cased, everything but letters, digits and white space turned into a space, spaces merged."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\p{Alnum}\s]", " "), r"(?U)\s+", " "))


def or_empty_word(x: Column) -> Column:
    """A side of a comparison that is null or empty becomes the word 'empty'."""
    return F.when(F.length(F.coalesce(x, F.lit(""))) == 0, "empty").otherwise(x)


def csv_field(x: Column) -> Column:
    """A text as the caption dump wrote it: quotes doubled, quoted only if it holds a comma."""
    doubled = F.replace(one_line(x), F.lit('"'), F.lit('""'))
    return F.when(x.contains(","), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(doubled)
