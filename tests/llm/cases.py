"""Documents with every oddity the operators must bear, and brute-force versions of what they compute."""
import collections
import math

CLASHING = "score double, key long, fp string, word string, label int, words string, held_out boolean, part int, rank int, component_id string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
NONE = (None,) * 10

PROSE = ("The river ran past the old mill and the children watched small boats drift under the stone bridge while their "
         "parents talked about the weather and the harvest that would come before the first cold nights of autumn")


def edge_rows():
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    return [
        (1, PROSE, "en", "a", 10, *NONE), (2, PROSE, None, None, None, *NONE), (2, PROSE, None, None, None, *NONE),
        (3, None, "en", "a", 0, *NONE), (4, "", "en", "a", 0, *NONE), (5, " \t\n\x0b\f\r ", "en", "a", 7, *NONE),
        (6, "one", "en", "a", 3, *NONE), (7, "one two", "en", "a", 7, *NONE), (None, PROSE + " indeed", "en", "a", 1, *NONE),
        (None, None, None, None, None, *NONE), (8, long, "en", "a", len(long), *NONE), (9, PROSE.upper(), "en", "a", 1, *NONE),
        (10, "x" * 200_000, "en", "a", 200_000, *NONE), (11, "été \U0001f600 中文 ½² a b", "fr", "b", 12, *NONE),
        (12, "\n\n" + PROSE + "\n" + PROSE + "\n\n", "en", "a", 1, *NONE), (13, "1" * 50_000 + "@" + "." * 1000, "en", "a", 1, *NONE),
    ]


def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (4, 0, 0), (6, 0, 1), (9, 0, 1), (12, 1, 0), (None, 1, 1), (8, None, None), (99, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def groups(nodes, linked):
    """Smallest node reachable from each, by following all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_groups(texts, size, least):
    """texts: id -> text; all pairs compared."""
    sets = {}
    for key, text in texts.items():
        words = (text or "").lower().split()
        sets[key] = {" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    where = collections.defaultdict(list)
    for key, found in sets.items():
        for s in found or {""}:
            where[s].append(key)
    common = collections.Counter()
    for keys in where.values():
        common.update((a, b) for i, a in enumerate(keys) for b in keys[i + 1:])
    alike = {pair: n / max(1, len(sets[pair[0]] | sets[pair[1]])) if sets[pair[0]] else 1.0 for pair, n in common.items()}
    return groups(sets, [pair for pair, s in alike.items() if s >= least]), alike


def unigram(texts, training):
    """Counts over the training texts, ends included."""
    tokens = {k: (t or "").encode().lower().split() + [None] for k, t in texts.items()}
    counts = collections.Counter(w for k in training for w in tokens[k])
    share = math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    return {k: (len(w), sum(counts[x] > 0 for x in w), sum(math.log10(counts[x] + 0.1) - share for x in w)) for k, w in tokens.items()}, sum(counts.values())
