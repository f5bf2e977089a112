"""Snowball stemmers after their published definitions; they run on distinct words only.

Words come folded to ASCII, as the index holds them, so endings with accents don't occur and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_KEPT = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
_WHOLE_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if first is None:
        m = re.search(f"[{_V}][^{_V}]", w)
        first = m.end() if m else len(w)
    m = re.search(f"[{_V}][^{_V}]", w[first:])
    return first, first + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _KEPT:
        return _KEPT[word]
    w = re.sub(f"(^|(?<=[{_V}]))y", "Y", word)
    r1, r2 = _regions(w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _WHOLE_1A:
        return w
    # 1b: past and continuous forms
    if w.endswith(("eed", "eedly")):
        n = 5 if w.endswith("eedly") else 3
        if len(w) - n >= r1:
            w = w[:-n] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and re.search(f"[{_V}]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif len(w) <= r1 and _short_end(w):
                w += "e"
    # 1c: final y
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2 to 4: derivations, longest ending first
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4] == "l") and (end != "li" or w[-3] in "cdeghkmnrt"):
                w = w[: len(w) - len(end)] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: len(w) - len(end)] + new
            break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    # 5: final e and l
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _after(w: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    m = re.search(f"[{vowels}][^{vowels}]", w[start:])
    return start + m.end() if m else len(w)


def _longest(w: str, ends: tuple[str, ...], start: int = 0) -> str | None:
    """The longest of some endings that a word has, from `start` on."""
    return max((e for e in ends if w.endswith(e) and len(w) - len(e) >= start), key=len, default=None)


def german(word: str) -> str:
    v = "aeiouy"
    w = re.sub(f"(?<=[{v}])[uy](?=[{v}])", lambda m: m[0].upper(), word)
    r1 = _after(w, v)
    r2, r1 = _after(w, v, r1), max(r1, 3)
    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and len(w) - len(end) >= r1 and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, ("en", "er", "est", "st"))
    if end and len(w) - len(end) >= r1 and (end != "st" or (len(w) >= 6 and w[-3] in "bdfghklmnt")):
        w = w[: -len(end)]
    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and len(w) - len(end) >= r2:
        rest = w[: -len(end)]
        if end in ("end", "ung"):
            w = rest
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            w = w if rest.endswith("e") else rest
        elif end in ("lich", "heit"):
            w = rest
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = rest
            more = _longest(w, ("lich", "ig"), r2)
            w = w[: -len(more)] if more else w
    return w.lower()


def _north(word: str, main: str, s_before: str, pairs: tuple[str, ...], other: Callable[[str, int], str], special: dict[str, str] | None = None) -> str:
    v = "aeiouy"
    w, r1 = word, max(3, _after(word, v))
    special = special or {}
    end = _longest(w, (*main.split(), "s", *special), r1)
    if end in special:
        w = w[: -len(end)] + special[end]
    elif end == "s":
        w = w[:-1] if w[-2:-1] and re.search(s_before, w[:-1]) else w
    elif end:
        w = w[: -len(end)]
    if _longest(w, pairs, r1):
        w = w[:-1]
    return other(w, r1)


def swedish(word: str) -> str:
    def other(w: str, r1: int) -> str:
        end = _longest(w, ("lig", "ig", "els", "fullt"), r1)
        return w if not end else w[:-1] if end == "fullt" else w[: -len(end)]

    main = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"
    return _north(word, main, "[bcdfghjklmnoprtvy]$", ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), other)


def danish(word: str) -> str:
    pairs = ("gd", "dt", "gt", "kt")

    def other(w: str, r1: int) -> str:
        if w.endswith("igst") and len(w) - 2 >= 0:
            w = w[:-2]
        end = _longest(w, ("ig", "lig", "elig", "els"), r1)
        if end:
            w = w[: -len(end)]
            if _longest(w, pairs, r1):
                w = w[:-1]
        return w[:-1] if len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouy" else w

    main = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"
    return _north(word, main, "[abcdfghjklmnoprtvyz]$", pairs, other)


def norwegian(word: str) -> str:
    def other(w: str, r1: int) -> str:
        end = _longest(w, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"), r1)
        return w[: -len(end)] if end else w

    main = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast"
    return _north(word, main, "([bcdfghjlmnoprtvyz]|[^aeiouy]k)$", ("dt", "vt"), other, {"erte": "er", "ert": "er"})


def dutch(word: str) -> str:
    v = "aeiouy"
    w = re.sub(f"(?<=[{v}])i(?=[{v}])|(?<=[{v}])y|^y", lambda m: m[0].upper(), word)
    r1 = _after(w, v)
    r2, r1 = _after(w, v, r1), max(r1, 3)

    def undouble(x: str) -> str:
        return x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def en_ending(x: str, end: str) -> str:
        rest = x[: -len(end)]
        return undouble(rest) if len(rest) >= r1 and rest and rest[-1] not in v and not rest.endswith("gem") else x

    def final_e(x: str) -> tuple[str, bool]:
        return (undouble(x[:-1]), True) if x.endswith("e") and len(x) - 1 >= r1 and x[-2:-1] not in tuple(v) else (x, False)

    end = _longest(w, ("heden", "ene", "en", "se", "s"))
    if end == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif end in ("en", "ene"):
        w = en_ending(w, end)
    elif end:
        rest = w[: -len(end)]
        w = rest if len(rest) >= r1 and rest and rest[-1] not in v + "j" else w
    w, e_gone = final_e(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        w = en_ending(w, "en") if w.endswith("en") else w
    end = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if end and len(w) - len(end) >= r2:
        rest = w[: -len(end)]
        if end in ("end", "ing"):
            w = rest[:-2] if rest.endswith("ig") and len(rest) - 2 >= r2 and not rest.endswith("eig") else undouble(rest)
        elif end == "ig":
            w = w if rest.endswith("e") else rest
        elif end == "lijk":
            w = final_e(rest)[0]
        elif end == "baar" or e_gone:
            w = rest
    if re.search(f"[^{v}](aa|ee|oo|uu)[^{v}I]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


_ES_1 = (
    (("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"), "", ()),
    (("adora", "ador", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"), "", ("ic",)),
    (("uciones",), "u", ()),
    (("encia", "encias"), "ente", ()),
    (("mente",), "", ("ante", "able", "ible")),
    (("idad", "idades"), "", ("abil", "ic", "iv")),
    (("iva", "ivo", "ivas", "ivos"), "", ("at",)),
)
_ES_2B = tuple(
    "arian arias arais aria ariais ariamos aremos aran aras are ara eriais erian erias eria eriamos eremos eran eras ere era irian irias iria iriais iriamos iremos iran iras ire ira "
    "aba ada ida ia ara iera ad ed id ase iese aste iste an aban ian aran ieran asen iesen aron ieron ado ido ando iendo io ar er ir as abas adas idas ias aras ieras ases ieses is ais abais iais arais ierais aseis ieseis asteis isteis ados idos amos abamos iamos imos aramos ieramos iesemos asemos".split()
)


def spanish(word: str) -> str:
    v = "aeiou"
    w, r1 = word, _after(word, v)
    r2 = _after(w, v, r1)
    if len(w) < 3:
        rv = len(w)
    elif w[1] not in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    elif w[0] in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    else:
        rv = 3
    pronoun = _longest(w, ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos"), rv)
    if pronoun:
        rest = w[: -len(pronoun)]
        verb = _longest(rest, ("ando", "iendo", "ar", "er", "ir", "yendo"), rv)
        if verb and (verb != "yendo" or rest.endswith("uyendo")):
            w = rest
    before = w
    end = _longest(w, (*(e for ends, _, _ in _ES_1 for e in ends), "amente"))
    if end == "amente":
        if len(w) - 6 >= r1:
            w = w[:-6]
            more = _longest(w, ("iv", "os", "ic", "ad"), r2)
            if more:
                w = w[: -len(more)]
                w = w[:-2] if more == "iv" and w.endswith("at") and len(w) - 2 >= r2 else w
    elif end and len(w) - len(end) >= r2:
        new, inner = next((n, i) for ends, n, i in _ES_1 if end in ends)
        w = w[: -len(end)] + new
        more = _longest(w, inner, r2)
        w = w[: -len(more)] if more else w
    if w == before:
        end = _longest(w, ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yas", "yes", "yais", "yamos"), rv)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _longest(w, (*_ES_2B, "en", "es", "emos"), rv)
            if end:
                w = w[: -len(end)]
                if end in ("en", "es", "emos") and w.endswith("gu"):
                    w = w[:-1]
    end = _longest(w, ("os", "a", "o", "e"), rv)
    if end:
        w = w[: -len(end)]
        if end == "e" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


_FR_I = tuple("i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split())
_FR_ER = tuple("er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split())
_FR_A = tuple("a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split())


def french(word: str) -> str:
    v = "aeiouy"
    w = re.sub("qu", "qU", word)
    w = re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), w)
    w = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", w)
    r1 = _after(w, v)
    r2 = _after(w, v, r1)
    if (len(w) > 2 and w[0] in v and w[1] in v) or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    start, again = w, False

    def cut(n: int, new: str = "") -> str:
        return w[: len(w) - n] + new

    plain = ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes")
    agent = ("atrice", "ateur", "ation", "atrices", "ateurs", "ations")
    ends = (*plain, *agent, "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences", "ement", "ements", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments")
    end = _longest(w, ends)
    if end:
        n, at = len(end), len(w) - len(end)
        if end in plain:
            w = cut(n) if at >= r2 else w
        elif end in agent:
            if at >= r2:
                w = cut(n)
                if w.endswith("ic"):
                    w = cut(2) if len(w) - 2 >= r2 else cut(2, "iqU")
        elif end.startswith("log"):
            w = cut(n, "log") if at >= r2 else w
        elif end.startswith(("usion", "ution")):
            w = cut(n, "u") if at >= r2 else w
        elif end.startswith("ence"):
            w = cut(n, "ent") if at >= r2 else w
        elif end in ("ement", "ements"):
            if at >= rv:
                w = cut(n)
                if w.endswith("iv") and len(w) - 2 >= r2:
                    w = cut(2)
                    w = cut(2) if w.endswith("at") and len(w) - 2 >= r2 else w
                elif w.endswith("eus"):
                    w = cut(3) if len(w) - 3 >= r2 else cut(3, "eux") if len(w) - 3 >= r1 else w
                elif w.endswith(("abl", "iqU")) and len(w) - 3 >= r2:
                    w = cut(3)
        elif end in ("if", "ive", "ifs", "ives"):
            if at >= r2:
                w = cut(n)
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = cut(2)
                    if w.endswith("ic"):
                        w = cut(2) if len(w) - 2 >= r2 else cut(2, "iqU")
        elif end == "eaux":
            w = cut(1)
        elif end == "aux":
            w = cut(2, "l") if at >= r1 else w
        elif end in ("euse", "euses"):
            w = cut(n) if at >= r2 else cut(n, "eux") if at >= r1 else w
        elif end in ("issement", "issements"):
            w = cut(n) if at >= r1 and w[at - 1 : at] not in tuple(v) else w
        elif end in ("amment", "emment"):
            w, again = (cut(n, "ant" if end[0] == "a" else "ent"), True) if at >= rv else (w, False)
        elif at - 1 >= rv and w[at - 1] in v:
            w, again = cut(n), True
    altered = w != start
    if not altered or again:
        end = _longest(w, _FR_I, rv)
        if end and len(w) - len(end) - 1 >= rv and w[-len(end) - 1] not in v:
            w, altered = cut(len(end)), True
        else:
            end = _longest(w, (*_FR_ER, *_FR_A, "ions"), rv)
            if end == "ions":
                if len(w) - 4 >= r2:
                    w, altered = cut(4), True
            elif end:
                w, altered = cut(len(end)), True
                if end in _FR_A and w.endswith("e") and len(w) - 1 >= rv:
                    w = cut(1)
    if altered:
        w = cut(1, "i") if w.endswith("Y") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aious":
            w = cut(1)
        end = _longest(w, ("ion", "ier", "Ier", "e"), rv)
        if end == "ion":
            w = cut(3) if len(w) - 3 >= r2 and w[-4] in "st" and len(w) - 4 >= rv else w
        elif end:
            w = cut(len(end), "" if end == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = cut(1)
    return w.lower()


STEMMERS: dict[str, Callable[[str], str]] = {"danish": danish, "dutch": dutch, "english": english, "french": french, "german": german, "norwegian": norwegian, "spanish": spanish, "swedish": swedish}


def stemmer(language: str) -> Callable[[str], str]:
    if language.lower() not in STEMMERS:
        raise ValueError(f"no stemmer for {language}; there are {', '.join(STEMMERS)}")
    return STEMMERS[language.lower()]
