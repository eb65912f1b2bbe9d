"""Surrogates by plain Python, one text after another: what the operator must give."""

from __future__ import annotations

import hashlib
import re

import regex

from frostline.llm import pii


def sha(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def draw(seed: str, n: int, most: int) -> int:
    return int(sha(seed, n)[:12], 16) % most


def scrambled(text: str, seed: str, hexadecimal: bool = False) -> str:
    out = []
    for i, c in enumerate(text):
        letter = draw(seed, i, 6 if hexadecimal else 26)
        out.append(str(draw(seed, i, 10)) if "0" <= c <= "9" else chr(97 + letter) if "a" <= c <= "z" else chr(65 + letter) if "A" <= c <= "Z" else c)
    return "".join(out)


def made_up(seed: str, attempt: int, script: str) -> str:
    parts = pii.SYLLABLES[script]
    return "".join(parts[draw(seed, 100 + k, len(parts))] for k in range(3 + max(0, attempt) // 2)).capitalize()


def luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def canonical(kind: str, mention: str, code: str | None) -> str:
    if kind == "email":
        return mention.lower()
    if kind in ("card", "ssn"):
        return digits_of(mention)
    if kind == "phone":
        d = digits_of(mention.replace("(0)", ""))
        return "+" + d if mention[0] == "+" else ("+" + code + d[1:] if code else d) if d[0] == "0" else "+1" + d
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "ip6":
        left, _, right = mention.lower().partition("::")
        a, b = left.split(":"), right.split(":") if right else []
        return ":".join(re.sub("^0+(?=.)", "", g) for g in a + ["0"] * (8 - len(a) - len(b)) + b)
    if kind == "secret":
        return re.search(r"[=:]\s?[\"']?([A-Za-z0-9+/_-]{8,})[\"']?$", mention)[1]
    return mention.capitalize() if kind.startswith("given") or kind == "surname" else mention


def country(phone: str) -> int:
    return 1 if phone[0] != "+" else 2 if phone[1] in "17" else 3 if phone[1:3] in pii.COUNTRIES else 4


def surrogate(kind: str, e: str, key: str, attempt: int) -> str:
    seed = sha(key, kind, e, attempt)
    late = attempt >= pii.SAME_LENGTH_ATTEMPTS
    grown = min(pii.GROWTH * (attempt - pii.SAME_LENGTH_ATTEMPTS + 1), pii.MOST_GROWTH)
    more, digits = f"{draw(seed, 98, 10**grown):0{grown}d}" if late else "", scrambled(e, seed)
    script = "cyrillic" if regex.search(r"\p{IsCyrillic}", e) else "latin"
    if kind == "email":
        local, domain = e.split("@")
        return scrambled(local, seed) + (seed[:8] if late else "") + "@" + scrambled(re.sub(r"\.[^.]+$", "", domain), seed + "d") + ".example"
    if kind == "phone":
        n = country(e)
        return e[:n] + str(draw(seed, 99, 8) + 2) + digits[n + 1 :] + more
    if kind == "card":
        body = e[0] + digits[1:-1] + more
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "ssn":
        return "9" + digits[1:] + more
    if kind == "ip":
        return ".".join([str(draw(seed, 0, 15) + 240), *(str(draw(seed, k, 254) + 1) for k in (1, 2, 3)), *([more] if late else [])])
    if kind == "ip6":
        return ":".join(["2001", "db8", *(f"{draw(seed, k, 65536):x}" for k in range(6))])
    if kind == "iban":
        account = digits[4:] + more
        return f"{e[:2]}{98 - iban_rest(e[:2] + '00' + account):02d}{account}"
    if kind == "key":
        return "AKIA" + digits[4:] + more
    if kind == "secret":
        return scrambled(e, seed, bool(re.fullmatch("[0-9a-f]+", e))) + (seed[:8] if late else "")
    if kind.startswith("given"):
        genders = {"m": "m", "f": "f", "n": "mf"}[kind[-1]]
        if attempt < pii.LISTED_ATTEMPTS:
            names = [n for g in genders for n in pii.GIVEN[g, script]]
            return names[draw(seed, 0, len(names))]
        return made_up(seed, attempt - pii.LISTED_ATTEMPTS, script) + {"m": ("o", "ий"), "f": ("a", "а"), "mf": ("is", "ья")}[genders][script == "cyrillic"]
    name = made_up(seed, attempt, script)
    return name if script == "latin" else name + ("ова" if e.lower().endswith("а") else "ов")


def draw_all(entities: set[tuple[str, str]], key: str) -> dict[tuple[str, str], str]:
    space = lambda kind: kind[:5] if kind.startswith("given") else kind
    taken, left, out, attempt = {(space(k), e) for k, e in entities}, set(entities), {}, 0
    while left:
        wanted: dict[tuple[str, str], tuple[str, str]] = {}
        for kind, e in left:
            at = space(kind), surrogate(kind, e, key, attempt)
            if at not in taken:
                wanted[at] = min(wanted.get(at, (e, kind)), (e, kind))
        for (_, drawn), (e, kind) in wanted.items():
            out[kind, e] = drawn
        taken |= set(wanted)
        left -= {(kind, e) for e, kind in wanted.values()}
        attempt += 1
    return out


def cased(mention: str, text: str) -> str:
    if mention.upper() == mention:
        return text.upper()
    return "".join(c.upper() if i < len(mention) and "A" <= mention[i] <= "Z" else c for i, c in enumerate(text))


def spelt(kind: str, mention: str, entity: str, new: str) -> str:
    if kind in ("phone", "card", "ssn", "iban"):
        if kind == "phone" and entity[0] == "+" != mention[0]:
            new = ("0" if digits_of(mention)[0] == "0" else "") + new[country(entity) :]
        rest, out = iter(new), []
        for part in re.split(r"(\(0\))", mention) if kind == "phone" else [mention]:
            out += part if part == "(0)" else [next(rest, "") if re.match("[A-Za-z0-9+]", c) else c for c in part]
        return "".join([*out, *rest])
    if kind == "secret":
        return mention.replace(entity, new)
    if kind == "email":
        return "@".join(cased(a, b) for a, b in zip(mention.split("@"), new.split("@"), strict=True))
    return new.upper() if mention.upper() == mention != mention.lower() else new


def roles(mention: str, gender: dict[str, str]) -> tuple[str, list[tuple[str, str | None]]] | None:
    """The words before a name, and its words with their kinds."""
    prefix = m[0] if (m := regex.match(pii.PREFIX, mention)) else ""
    words = mention[len(prefix) :].split(" ")
    known = [gender.get(regex.match(r"\p{L}+", w)[0].capitalize()) for w in words]
    n = next((i for i, w in enumerate(words) if w in pii.NO_NAME), len(words))
    title = next((g for g in "fmn" for t in pii.TITLES[g] if regex.search(rf"(?<!\p{{L}}){t}\.? $", prefix)), "")
    if prefix:
        first, last = 0, n - 1
    else:
        first = next((i for i, g in enumerate(known) if g), None)
        if first is None:
            return None
        high = first
        while high - first < 3 and high + 1 < n and known[high + 1]:
            high += 1
        last = high + 1 if high + 1 < n else high if high > first else -1
    if n == 0 or last < first:
        return None
    out: list[tuple[str, str | None]] = []
    for i, w in enumerate(words):
        if not first <= i <= last:
            out.append((w, None))
        elif i == last and (first != last or title):
            out.append((w, "surname"))
        else:
            out.append((w, "given_" + (title.strip("n") or known[i] or known[first] or "n")))
    return prefix, out


def plain(texts: list[str | None], key: str, names: list[tuple[str, str]] | None = None, code: str | None = None) -> list[tuple[str | None, int, str]]:
    """(text, mentions replaced, kinds) of each text."""
    gender = dict(names if names is not None else pii.known_names(pii.GIVEN))
    found: dict[str, tuple[str, str, list]] = {}  # mention: kind, prefix, words of parts (word, kind or None)
    cut = [[(m.start(), m.end()) for m in regex.finditer(pii.ANY, t or "")] for t in texts]
    for mention in {t[a:b] for t, spans in zip(texts, cut, strict=True) for a, b in spans}:
        kind = next(k for k, p in pii.PATTERNS if regex.fullmatch(p, mention))
        if kind == "name":
            if named := roles(mention, gender):
                found[mention] = kind, named[0], [[(p, k if len(p) > 1 else None) for p in re.findall("[-'’]|[^-'’]+", w)] for w, k in named[1]]
        elif kind not in ("card", "iban") or (kind == "card" and luhn(digits_of(mention)) == 0) or (kind == "iban" and iban_rest(mention.replace(" ", "")) == 1):
            found[mention] = kind, "", [[(mention, kind)]]
    told: dict[str, set[str]] = {}
    for _, _, words in found.values():
        for w, k in (x for part in words for x in part):
            if k in ("given_m", "given_f"):
                told.setdefault(canonical(k, w, code), set()).add(k)

    def settled(w: str, k: str) -> tuple[str, str]:
        e = canonical(k, w, code)
        return (next(iter(told[e])) if k == "given_n" and len(told.get(e, ())) == 1 else k), e

    drawn = draw_all({settled(w, k) for _, _, words in found.values() for part in words for w, k in part if k}, key)

    def new(w: str, k: str | None) -> str:
        if k is None:
            return w
        kind, e = settled(w, k)
        return spelt(kind, w, e, drawn[kind, e])

    replaced = {m: (kind, prefix + " ".join("".join(new(w, k) for w, k in part) for part in words)) for m, (kind, prefix, words) in found.items()}
    out: list[tuple[str | None, int, str]] = []
    for text, spans in zip(texts, cut, strict=True):
        done, at, kinds, n = [], 0, set(), 0
        for a, b in spans:
            if text[a:b] in replaced:
                kind, by = replaced[text[a:b]]
                done += [text[at:a], by]
                at, n = b, n + 1
                kinds.add(kind)
        out.append((text if text is None else "".join(done) + text[at:], n, ",".join(sorted(kinds))))
    return out
