"""Russian nouns, adjectives and verbs in all their forms, as patterns: a stem, and the endings of its class."""

from __future__ import annotations

CASES = "ам ами ах"
#: Endings by class: gender, and what the stem or the dictionary form ends in. A dash stands for no ending.
NOUN = {
    "m": f"- а у ом е ы ов {CASES}",
    "m к": f"- а у ом е и ов {CASES}",
    "m ок": "ок ка ку ком ке ки ков кам ками ках",
    "m ец": "ец ца цу цом це цы цов цам цами цах",
    "m й": "й я ю ем е и ев ям ями ях",
    "m ий": "ий ия ию ием ии иев иям иями иях",
    "m ь": "ь я ю ем е и ей ям ями ях",
    "f": f"а ы е у ой ою - {CASES}",
    "f г": f"а и е у ой ою - {CASES}",
    "f ка": "ка ки ке ку кой кою ок кам ками ках",
    "f шка": "ка ки ке ку кой кою ек кам ками ках",
    "f ля": "ля ли ле лю лей ель лям лями лях",
    "f ча": f"а и е у ой ею ей - {CASES}",
    "f ь": "ь и ью ей ям ями ях",
    "f ия": "ия ии ию ией ий иям иями иях",
    "f ья": "ья ьи ье ью ьей ей ьям ьями ьях",
    "n": f"о а у ом е - {CASES}",
    "n ие": "ие ия ию ием ии ий иям иями иях",
    "-": "-",
}
ADJECTIVE = {
    "ый": "ый ая ое ые ого ой ому ую ым ом ых ыми",
    "ий": "ий ая ое ие ого ой ому ую им ом их ими",
    "щий": "ий ая ее ие его ей ему ую им ем их ими",
}
#: A verb's infinitive, and what leaflets say: they do, we do, is done, do.
VERB = {"ать": "ть ют ем ется йте", "овать": "овать уют уем уется уйте"}


def ending(kind: str) -> list[str]:
    for table in (NOUN, ADJECTIVE, VERB):
        if kind in table:
            return [e.strip("-") for e in table[kind].split()]
    raise ValueError(f"no class of words: {kind}")


def forms(word: str) -> list[str]:
    """All forms of 'stem:class'; a word without a class has itself alone."""
    stem, _, kind = word.partition(":")
    return [stem + e for e in ending(kind)] if kind else [stem]


def pattern(*words: str) -> str:
    """Any form of any of the words; a hyphen may be a space or left out, a space may be any white space, ё stands for е."""
    out = []
    for word in words:
        stem, _, kind = word.partition(":")
        text = stem.replace("-", r"[-\s]?").replace(" ", r"\s+").replace("ё", "[её]")
        ends = sorted(ending(kind), key=lambda e: -len(e)) if kind else []
        out.append(text + (f"(?:{'|'.join(ends)})" if ends != [""] and ends else ""))
    return f"(?:{'|'.join(out)})"


def shortened(*words: str) -> str:
    """Short spellings, with a point or without."""
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")\.?"
