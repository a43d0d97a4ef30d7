"""Plain Python versions of the contracts, for small tables."""

import re
from collections import Counter
from hashlib import sha256


def hexed(text) -> str:
    return sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def op4(docs, benchmark):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = {}
    for i, t in benchmark:
        w = word.findall(lower(t or ""))
        if w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                items.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    lens = {len(k) for k in items}
    out = []
    for i, t in docs:
        w = word.findall(lower(t or ""))
        hit, got = set(), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in items:
                    hit |= set(range(k, k + n))
                    got |= items[x]
        out.append((i, len(w), len(hit), len(got), hexed(",".join(sorted(got))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op7(docs):
    kinds = [
        ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    out = []
    for i, t in docs:
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m))
        n = Counter(x[2] for x in spans)
        out.append((i, n["assign"], n["access"], n["hex"], hexed(",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in spans))))
    return out


def op8(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    return out


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def op9(docs):
    t = tokenizer()
    n = [len(e.ids) for e in t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)]
    return [(i, len((x or "").encode()), k, k > 512) for (i, x), k in zip(docs, n, strict=True)]


def check_op3(docs, got):
    """Asserts that got's pieces are a gapless packing of docs; returns tokens per padded token."""
    import zlib
    from collections import defaultdict

    import numpy as np

    t = tokenizer()
    left, packs = {}, defaultdict(list)
    for i, x in docs:
        left[i] = [*t.encode(x or "", add_special_tokens=False).ids, 0]
    seen = defaultdict(int)
    for doc, start, length, crc, total, sequence, offset in sorted(got):
        assert total == len(left[doc]) and seen[doc] == start and length > 0
        assert zlib.crc32(np.array(left[doc][start : start + length], "<u4").tobytes()) == crc
        seen[doc] += length
        packs[sequence].append((offset, length))
    assert all(seen[i] == len(x) for i, x in left.items())
    padded = 0
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
        padded += at if at & (at - 1) == 0 else 1024
    return sum(map(len, left.values())) / padded


def op10(docs):
    sets = []
    for _, x in docs:
        w = WORD.findall(lower(x or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    where = {}
    for k, s in enumerate(sets):
        near = {}
        for g in s:
            for j in where.setdefault(g, []):
                near[j] = near.get(j, 0) + 1
            where[g].append(k)
        for j, both in near.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)]


def op5(docs, size=35):
    split = [WORD.findall(x or "") for _, x in docs]
    seen = Counter(tuple(w[k : k + size]) for w in split for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        out.append((i, len(w), len(gone), hexed(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def op1(docs, size=50):
    least = {}
    texts = [(2**63 if i is None else i, (x or "").encode()) for i, x in docs]
    for i, b in texts:
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if least[b[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((None if i == 2**63 else i, len(b), sum(gone), spans, hexed(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def op6_base(docs):
    import math
    import zlib

    split = [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, [*WORD.findall(lower(x or "")), None]) for i, x in docs]
    c = Counter(w for _, held, t in split if not held for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, held, t in split]


def op6_scores(docs, depth, gain_limit, discount, share):
    """(doc_id, score) by the tree's rules with plain dictionaries of words."""
    import math
    import re
    import zlib
    from collections import Counter, defaultdict

    def tokens(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [tokens(t) for i, t in docs if not held(i)]
    words = Counter(w for t in train for w in t)
    total = sum(words.values())
    scale = total + 0.5 * (len(words) + 1)
    least = max(2, math.ceil(share * total ** (2 / 3)))
    grams = Counter(tuple(t[k - n : k + 1]) for t in train for k in range(len(t)) for n in range(1, depth + 1) if k >= n)
    tree: dict = {}

    def p(context, w):
        """The probability of w behind the context's longest retained suffixes."""
        if not context:
            return (words[w] + 0.5) / scale
        shorter = p(context[1:], w)
        if context not in tree:
            return shorter
        listed, rest = tree[context]
        return listed[w] if w in listed else shorter * rest

    for n in range(1, depth + 1):
        by_context = defaultdict(dict)
        for g, c in grams.items():
            if len(g) == n + 1 and c >= least:
                by_context[g[:-1]][g[-1]] = c
        fresh = {}
        for context, nexts in by_context.items():
            of_context = words[context[0]] if n == 1 else grams[context]
            listed = {w: (c - discount) / of_context for w, c in nexts.items()}
            base = {w: p(context[1:], w) for w in nexts}
            rest = max(1 - sum(listed.values()), 1e-9) / max(1 - sum(base.values()), 1e-9)
            gain = sum(c * math.log(listed[w] / base[w]) for w, c in nexts.items()) + (of_context - sum(nexts.values())) * math.log(rest)
            if gain > gain_limit:
                fresh[context] = (listed, rest)
        tree |= fresh
    score = lambda t: sum(math.log10(p(tuple(t[max(0, k - depth) : k]), w)) for k, w in enumerate(t))
    return [(i, score(tokens(t))) for i, t in docs], Counter(map(len, tree))


def host_verdicts(rows, limit):
    """host: rejected; rows: (host, measures of op8 from n_words on, lines with words) of every document."""
    from collections import defaultdict

    fails = defaultdict(list)
    for host, n, chars, symbols, dup, repeats, lines in rows:
        fails[host].append((n < 50, 100 * repeats > 50 * n, 2 * symbols > n, 10 * dup > 3 * lines, chars < 2 * n or chars > 15 * n))
    out = dict.fromkeys(fails, False)
    for rule in range(5):
        found = {h: (sum(x[rule] for x in f), len(f)) for h, f in fails.items()}
        total = sum(n for _, n in found.values())
        mean = sum(r for r, _ in found.values()) / total
        spread = sum(n * (r / n - mean) ** 2 for r, n in found.values()) / total
        weight = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else 1000.0
        for h, (r, n) in found.items():
            out[h] |= (r + mean * weight) / (n + weight) > limit
    return out


def op11(docs, seed=7, percent=100, spm_percent=50):
    out = []
    for i, t in docs:
        t = t or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = [int(hexed(f"{seed}:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
            out.append((i, len(units), "plain", None, None, hexed(t), hexed(t)))
        elif h[3] % 100 < spm_percent:
            out.append((i, len(units), "spm", len(prefix), len(middle), hexed(f"<S>{suffix}<P>{prefix}<M>{middle}"), hexed(t)))
        else:
            out.append((i, len(units), "psm", len(prefix), len(middle), hexed(f"<P>{prefix}<S>{suffix}<M>{middle}"), hexed(t)))
    return out


def op12_rules(url, rules):
    """host, path, rule and the rule's verdict of a URL."""
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fits = [(len(r), r, v) for v, r in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def op12_model(urls, order):
    """Counts by context of every URL's bytes, from dictionaries."""
    model = {}
    for u in urls:
        s = [2, *u, 3]
        for k in range(1, len(s)):
            for n in range(min(order, k) + 1):
                model.setdefault(tuple(s[k - n : k]), Counter())[s[k]] += 1
    return model


def op12_score(url, accepted, rejected, order):
    import math

    def likelihood(model):
        s, total = [2, *url, 3], 0.0
        for k in range(1, len(s)):
            p = 1 / 256
            for n in range(min(order, k) + 1):
                if (c := model.get(tuple(s[k - n : k]))) is None:
                    break
                p = (c[s[k]] + len(c) * p) / (sum(c.values()) + len(c))
            total += math.log(p)
        return total

    return (likelihood(rejected) - likelihood(accepted)) / (len(url) + 1)


def op13(rows, least=30, top=50):
    """rows: (lang, source, text)."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    df, groups, langs = {}, {}, {}
    for lang, source, t in rows:
        lang, source = lang or "", source or ""
        c = Counter(term.findall(lower(t or "")))
        groups.setdefault((lang, source), Counter()).update(c)
        langs.setdefault(lang, Counter()).update(c)
        df.setdefault(lang, Counter()).update(c.keys())
    kept = {x: sorted(w for w, k in c.items() if k >= least) for x, c in df.items()}

    def shares(lang, c):
        whole = sum(c[w] for w in kept[lang]) + 5 * len(kept[lang])
        return {w: 1 + 10**9 * (c[w] + 5) // whole for w in kept[lang]}

    p = {g: shares(g[0], c) for g, c in groups.items()}
    q = {x: shares(x, c) for x, c in langs.items()}
    out = []
    for (lang, source), mine in p.items():
        pairs = [(s, sum(abs(mine[w] - x[w]) for w in kept[lang])) for (other, s), x in p.items() if other == lang and s != source]
        terms = [(w, mine[w] - q[lang][w]) for w in kept[lang] if groups[(lang, source)][w] and mine[w] > q[lang][w]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, w, v, k + 1) for k, (w, v) in enumerate(ordered)]
    return out
