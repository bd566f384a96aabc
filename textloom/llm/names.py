"""Spellings of persons and groups that mean the same one.

Names are folded to tokens. A symmetric-delete index over the distinct tokens finds those within one
edit. The rarest token of a name (a surname, or what sets a group apart) is its anchor; names meet
where their anchors are near and another token is near, too, or may be what an initial stands for.
What meets is compared by the optimal assignment of all its tokens, in any order, where initials,
abbreviations and nicknames may stand for a name.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.plans.scratch import Scratch

#: A key that more signatures share is hot: its pairs are made by SALTS tasks.
HOT, SALTS = 500, 16

# Full names, and the short ones that may stand for them.
_SHORT_FORMS = """
albert: al bert | alexander: alex sascha sasha sandy | anthony: tony | antonia: toni | catherine: cathy kate | christina: tina chris | christopher: chris
daniel: dan danny | david: dave | edward: ed eddie ted | elizabeth: betty liz beth lisa lizzy | francisco: paco pancho | frederick: fred freddy
friedrich: fritz | giuseppe: beppe pino | gregory: greg | guadalupe: lupe | heinrich: heinz | henry: harry | herbert: bert | ignacio: nacho | ivan: vanya
james: jim jimmy | jeffrey: jeff | johannes: hans hannes jan | john: jack johnny | jose: pepe | josef: sepp | josemaria: chema | joseph: joe
katherine: kate kathy katie | kenneth: ken | lawrence: larry | margaret: peggy maggie meg | matthew: matt | michael: mick mike mischa micky
mikhail: misha | nicholas: nick | nikolai: kolya | nikolaus: klaus | patricia: pat | peter: pete | richard: dick rick rich | robert: bob rob bobby bert
ronald: ron | samuel: sam | stefan: steffen | steven: steve | susanna: sanna susi sue | theodore: ted theo teddy | thomas: tom tommy | ulrich: uli
ulrika: ulla | victoria: vicky | william: bill will billy
"""
NICKNAMES: dict[str, frozenset[str]] = {}
for _entry in re.split(r"[|\n]", _SHORT_FORMS.strip()):
    _full, _, _shorts = _entry.partition(":")
    for _short in _shorts.split():
        NICKNAMES[_short] = NICKNAMES.get(_short, frozenset()) | {_full.strip()}
GIVEN = frozenset(NICKNAMES) | frozenset().union(*NICKNAMES.values())
# Particles of surnames, and how two of them are abbreviated.
PARTICLES = frozenset("van von vom der den de del della di da dos du la le ter ten te zu zur af av el bin ibn".split())
_PARTICLE_SHORT = {"vd": "vander", "v": "von"}
#: Between a particle and its surname, which may also be written without it.
_BOUND = "~"
# Words of groups, words that carry nothing, acronyms.
_GROUP = re.compile(r"(?i)\b(?:group|consor\w*|network|registry|register|study|studies|investigators?|invest\.|grp|netw|cons$|team|collaborat\w+|committee|society|alliance|initiative|trialists|wg|project|programme|program)\b|\bcons\.")
_EMPTY = frozenset("the and of on for in at a an de des der die das und et la le y el".split())
_ACRONYMS = {
    "wg": ["working", "group"], "sg": ["study", "group"], "grp": ["group"], "gp": ["group"], "netw": ["network"], "cons": ["consortium"], "consort": ["consortium"],
    "invest": ["investigators"], "reg": ["registry"], "collab": ["collaboration"], "soc": ["society"], "pediatric": ["paediatric"], "res": ["research"],
}

_DEGREE = re.compile(r",?\s*\b(?:M\.?D|Ph\.?D|D\.?Sc|M\.?Sc|MPH|FRCP|RN|Jr|Sr)\b\.?$")
_QUOTED = re.compile(r"[\"“”„]([^\"“”„]+)[\"“”„]|\(([^()]+)\)")


def fold(text: str) -> str:
    """No case, accents or apostrophes; all hyphens alike. An umlaut written as two letters is one edit away."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return re.sub(r"['’ʼ`´]", "", re.sub(r"[‐‑]", "-", text)).replace("ø", "o").strip("-")


def _near(a: str, b: str) -> bool:
    """Within one insertion, deletion, change or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]


def near_words(a: str, b: str, least: int = 4) -> bool:
    """Within one edit; words of fewer than ``least`` letters only by a swap, since many short names are an edit apart."""
    return _near(a, b) and (min(len(a), len(b)) >= least or len(a) == len(b) >= 3 and sorted(a) == sorted(b))


_TWO = frozenset(a + b for a in ("van", "von", "de", "af", "av", "zu") for b in ("der", "den", "de", "la", "ter"))


def _particle(token: str, pieces: list[str]) -> tuple[str, bool]:
    """The particle's part of a token as typed, and whether a surname must follow; '' where it has none.

    Particles are known by their small letters, so one with a typing error, or with a blank that
    was lost or went astray, is still glued to its surname.
    """
    small = re.match(r"[a-zà-öø-ÿ.'’]*", token).group()
    letters = fold(re.sub(r"[.]", "", small))
    if not letters:
        return (fold(token), True) if len(token) > 2 and fold(token) in PARTICLES and pieces != [token] else ("", False)
    if len(letters) > 4 and not any(_near(letters, two) for two in _TWO):
        return "", False
    return letters, len(token) - len(small) < 2


def _glued(text: str) -> tuple[list[tuple[str, bool]], int]:
    """(token as typed, is a surname with its particles) of a person's name; how many of them stand before a comma."""
    head, comma, tail = text.partition(",")
    out: list[tuple[str, bool]] = []
    before = 0
    for part in (head, tail):
        before = before or len(out)
        run, pieces = "", part.split()
        for k, token in enumerate(pieces):
            particle, open_ = _particle(token, pieces)
            if particle and (open_ or run or len(particle) > 2):
                after = re.sub(r"^[a-zà-öø-ÿ.'’]*", "", token) if not particle or particle != fold(token) else ""
                run += particle
                if not open_:
                    out.append((_PARTICLE_SHORT.get(run, run) + _BOUND + after, True))
                    run = ""
                elif after:  # its first letter came before the blank
                    pieces[k + 1 : k + 2] = [after + x for x in pieces[k + 1 : k + 2]]
            elif run:
                out.append((_PARTICLE_SHORT.get(run, run) + _BOUND + token, True))
                run = ""
            else:
                out.append((token, False))
        if run and out:  # a particle behind the given name belongs to the surname before the comma
            out[0] = (_PARTICLE_SHORT.get(run, run) + _BOUND + out[0][0], True)
        elif run:
            out.append((run, False))
    return out, before if comma and tail.strip() else 0


def parse(name: str) -> tuple[bool, int, list[str], str]:
    """(is a group, place of the surname or -1, full tokens in order, initials)."""
    text = re.sub(r"\s+", " ", name.replace("\u00a0", " ")).strip()
    if _GROUP.search(text):
        tokens: list[str] = []
        for token in re.findall(r"[^\W_]+(?:['’\-][^\W_]+)*", text.replace("&", " and ")):
            token = fold(token).replace("-", "")
            if token not in _EMPTY:
                tokens.extend(_ACRONYMS.get(token, [token]))
        return True, -1, tokens, ""
    text = _QUOTED.sub(" ", _DEGREE.sub("", text)).strip()
    pieces, before = _glued(text)
    tokens, initials, surname = [], "", -1
    for place, (token, known) in enumerate(pieces):
        letters = re.sub(r"[^\w]", "", token)
        if not letters:
            continue
        parts = [p for p in re.split(r"[.\-‐‑]+", token) if p]
        if not known and (all(len(p) == 1 for p in parts) and len(parts) <= 3 or len(letters) == 1):
            initials += fold(letters)
            continue
        folded = fold(token.replace(".", ""))
        if folded and place < before and surname == 0:
            tokens[0] += f"-{folded}"  # a surname of several words, as if they were joined
        elif folded:
            if known or place < before and not tokens:
                surname = len(tokens)
            tokens.append(folded)
    return False, surname, tokens, initials


def _forms(anchor: str) -> tuple[str, ...]:
    """A surname with its particles as one word, and without them."""
    particle, bound, bare = anchor.rpartition(_BOUND)
    return (particle + bare, bare) if bound and len(bare) >= 3 else (particle + bare,)


_NO = 9.0


def _stands_for(token: str) -> frozenset[str]:
    return NICKNAMES.get(token, frozenset()) | {token}


def _cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if _stands_for(a) & _stands_for(b):
        return 0.2
    if len(a) == 1 or len(b) == 1:
        full, letter = (b, a) if len(a) == 1 else (a, b)
        return 0.4 if any(x[:1] == letter for x in _stands_for(full)) else _NO
    # a nickname is no typing error of another name: Sanna is not Anna
    if any(near_words(x, y) for x in NICKNAMES.get(a, (a,)) for y in NICKNAMES.get(b, (b,))):
        return 1.0
    short, full = sorted((a, b), key=len)
    if len(short) >= 5 and full.startswith(short) and len(full) - len(short) >= 3:
        return 0.6  # an abbreviation
    return _NO


def assigned(costs: np.ndarray) -> list[int]:
    """The column of each row in an assignment of least total cost, by shortest augmenting paths; rows are at most as many as columns."""
    n, m = costs.shape
    of_row, of_column = np.zeros(n + 1), np.zeros(m + 1)
    owner = [0] * (m + 1)  # of a column, from 1; 0: free
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, seen, came = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while owner[at]:
            seen[at] = True
            slack = costs[owner[at] - 1] - of_row[owner[at]] - of_column[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], at
            step = int(np.argmin(np.where(seen[1:], np.inf, least[1:]))) + 1
            delta = least[step]
            for j in np.flatnonzero(seen):
                of_row[owner[j]] += delta
                of_column[j] -= delta
            least[1:][~seen[1:]] -= delta
            at = step
        while at:
            owner[at], at = owner[came[at]], int(came[at])
    places = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            places[owner[j] - 1] = j - 1
    return places


def alignment(a: list[str], b: list[str]) -> float:
    """Least total cost of assigning the tokens of the shorter list to different ones of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if len(b) > 6:
        costs = np.array([[_cost(x, y) for y in b] for x in a])
        return float(sum(costs[i, j] for i, j in enumerate(assigned(costs))))

    @lru_cache(maxsize=None)
    def best(i: int, used: int) -> float:
        if i == len(a):
            return 0.0
        return min(_cost(a[i], b[j]) + best(i + 1, used | 1 << j) for j in range(len(b)) if not used >> j & 1)

    return best(0, 0)


def _given(tokens: list[str]) -> list[str]:
    return [p for t in tokens for p in t.split("-") if p]


def same_name(group: bool, a: list[str], a_initials: str, b: list[str], b_initials: str) -> str:
    """How two names, anchor first, can mean the same: '' not at all; 'full' by full tokens or, lacking these on both
    sides, by initials; 'first' or 'second' where that one has an initial for a full token of the other.

    Every full token of the other parts is matched, in any order, by one within an edit, a nickname
    or an initial; left over may be initials of one side only, and two typing errors at most remain.
    """
    if not a or not b:
        return ""
    if group:
        return "full" if len(a) == len(b) and alignment(a, b) <= 2.0 else ""
    errors = float(not {*_forms(a[0])} & {*_forms(b[0])})
    if errors and not any(near_words(x, y, 5) for x in _forms(a[0]) for y in _forms(b[0])):
        return ""
    full_a, full_b = _given(a[1:]), _given(b[1:])
    if not full_a and not full_b:
        # what is left of the initials on either side must agree with the other
        begins = a_initials.startswith(b_initials) or b_initials.startswith(a_initials)
        return "full" if a_initials and b_initials and begins else ""
    if len(full_a) == len(full_b) or full_a and full_b and near_words("".join(full_a), "".join(full_b)):
        whole = alignment(full_a, full_b) if len(full_a) == len(full_b) else _NO
        if len(full_a) + len(full_b) > 2:  # parts may be written as one word
            joined = "".join(full_a), "".join(full_b)
            whole = min(whole, 0.0 if joined[0] == joined[1] else 1.0 if near_words(*joined) else _NO)
        # two middle initials must agree
        middle = not (a_initials and b_initials) or a_initials.startswith(b_initials) or b_initials.startswith(a_initials)
        return "full" if middle and errors + whole <= 2.0 else ""
    first = len(full_a) < len(full_b)
    few, letters, many, others = (full_a, a_initials, full_b, b_initials) if first else (full_b, b_initials, full_a, a_initials)
    if not few:  # initials only: the first stands for the first given name
        fits = letters and any(x[:1] == letters[0] for x in _stands_for(many[0]) | _stands_for("".join(many)))
        return ("first" if first else "second") if fits else ""
    short = [*few, *letters]
    if len(short) < len(many) or others and len(letters) > len(many) - len(few):
        return ""
    return ("first" if first else "second") if errors + alignment(many, short) <= 2.0 else ""


def _deletes(token: Column) -> Column:
    """The token and what is left of it after each single deletion."""
    cut = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.array_distinct(F.concat(F.array(token), F.when(F.length(token) >= 3, cut).otherwise(F.array().cast("array<string>"))))


def near_tokens(tokens: DataFrame, token: str = "token", least: int = 4) -> DataFrame:
    """``a, b``: different tokens within one insertion, deletion, change or swap of neighbours, as ``near_words`` has it.

    Two tokens that are so near share a token of their delete neighbourhoods; the index is joined
    on that. A neighbourhood is as long as its token, and few tokens share a member of it. A
    surname with particles is also indexed without them.
    """
    whole, bare = F.replace(F.col(token), F.lit(_BOUND), F.lit("")), F.element_at(F.split(token, _BOUND), -1)
    forms = F.array_distinct(F.when(F.length(bare) >= 3, F.array(whole, bare)).otherwise(F.array(whole)))
    index = tokens.select(F.col(token).alias("t"), F.explode(forms).alias("f")).select("t", "f", F.explode(_deletes(F.col("f"))).alias("d"))
    # Spark takes an index for as small as the tokens' file, which it exceeds many times: it is never sent to all tasks
    pairs = index.select(F.col("t").alias("a"), F.col("f").alias("fa"), "d").hint("merge").join(index.select(F.col("t").alias("b"), F.col("f").alias("fb"), "d"), "d")
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.abs(F.length("fa") - F.length("fb")) <= 1)).select("a", "b", "fa", "fb").distinct()

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near_words(x, y, least) for x, y in zip(a, b, strict=True)], dtype=bool)

    pairs = pairs.filter(close("fa", "fb")).select("a", "b").distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def link_names(names: DataFrame, name: str) -> DataFrame:
    """``name, mentions, class_id, signature``: the spellings of ``names`` with the class each belongs to.

    A spelling is compared exactly as given, once, whatever its number of rows; null and blank
    names don't count. Spellings of one class mean the same person or group. Names with an initial
    for a given name only join the class of a full name if exactly one fits. Names without any full
    token stand alone, each in its class. Texts of any length are read whole.
    """
    spark = names.sparkSession
    scratch = Scratch(spark, "names")

    @F.pandas_udf("is_group boolean, surname int, tokens array<string>, initials string")
    def parsed_as(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(n) for n in texts], columns=["is_group", "surname", "tokens", "initials"])

    distinct = names.select(F.col(f"`{name}`").cast("string").alias("name")).filter(F.length(F.trim("name")) > 0).groupBy("name").agg(F.count("*").alias("mentions"))
    parsed = scratch.write(distinct.withColumn("p", parsed_as("name")).select("name", "mentions", "p.*"), "parsed")

    # tokens with their mentions; a typing error of a far more frequent token is read as that one
    at = parsed.select("name", "mentions", "surname", F.posexplode("tokens").alias("pos", "token"))
    counts = scratch.write(at.groupBy("token").agg(F.sum("mentions").alias("m")), "tokens")
    near = scratch.write(near_tokens(counts), "near")
    m_a = counts.select(F.col("token").alias("a"), F.col("m").alias("m_a"))
    m_b = counts.select(F.col("token").alias("b"), F.col("m").alias("m_b"))
    better = near.join(m_a, "a").join(m_b, "b").filter((F.col("m_b") >= 5 * F.col("m_a")) & (F.col("m_b") >= 5) & (F.length("a") >= 4))
    better = better.groupBy("a").agg(F.max(F.struct("m_b", "b")).alias("best")).select(F.col("a").alias("token"), F.col("best.b").alias("read"))
    at = at.join(better, "token", "left").withColumn("read", F.coalesce("read", "token"))
    # given names and words of groups stand beside many others, surnames beside few; what is beside a token is one number
    whole = at.groupBy("name").agg(F.bit_xor(F.xxhash64("read")).alias("whole"))
    beside = at.select("name", "read").join(whole, "name").select("read", F.expr("whole ^ xxhash64(read)").alias("rest")).filter("rest <> 0")
    partners = beside.distinct().groupBy("read").agg(F.count("*").alias("partners"))
    # and some names tell which of their tokens is the surname, by a comma or a particle
    role = F.when(F.col("surname") < 0, 0).when(F.col("surname") == F.col("pos"), 1).otherwise(-1)
    roles = at.groupBy("read").agg(F.sum(role * F.col("mentions")).alias("role"))
    at = at.join(partners, "read", "left").join(roles, "read").na.fill(0, ["partners"])
    listed = at.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "read", "partners", "role"))).alias("ts"))
    listed = parsed.select("name", "mentions", "is_group", "surname", "initials").join(listed, "name", "left")

    @F.pandas_udf("anchor string, others array<string>")
    def signature(is_group: pd.Series, surname: pd.Series, ts: pd.Series) -> pd.DataFrame:
        rows = []
        for group, known, tokens in zip(is_group, surname, ts, strict=True):
            tokens = [] if tokens is None else list(tokens)
            if not tokens:
                rows.append((None, []))
                continue
            beside = [t["partners"] + (1000 if not group and t["read"] in GIVEN else 0) for t in tokens]
            fewest = min(beside)
            k = max(known, 0)
            if group or len(tokens) > 1 and known < 0:
                k = beside.index(fewest)
                # only a clear difference tells a given name from a surname that stands first
                if not group and beside[0] < 2 * max(fewest, 1):
                    k = 0
                told = [t["role"] for t in tokens]
                if not group and max(told) > 0 >= sorted(told)[-2]:
                    k = told.index(max(told))
            others = [t["token"] if t["token"] in NICKNAMES else t["read"] for i, t in enumerate(tokens) if i != k]
            if group:
                rows.append((tokens[k]["read"], sorted(others)))
            else:  # the anchor as it is written: its near ones are found by the index
                rows.append((tokens[k]["token"].replace("-", ""), others))
        return pd.DataFrame(rows, columns=["anchor", "others"])

    named = listed.withColumn("s", signature("is_group", "surname", "ts")).select("name", "mentions", "is_group", "initials", "s.*")
    # no full token at all: nothing to compare by
    named = named.withColumn("sig", F.xxhash64("is_group", F.coalesce("anchor", F.concat(F.lit("="), "name")), F.array_join("others", " "), "initials"))
    named = scratch.write(named, "named")
    told = F.col("anchor").isNotNull() & (F.col("is_group") | (F.size("others") > 0) | (F.col("initials") != ""))
    sigs = named.filter(told).groupBy("sig").agg(*(F.first(c).alias(c) for c in ("is_group", "anchor", "others", "initials")))
    sigs = scratch.write(sigs, "signatures")
    anchors = sigs.select("anchor").distinct()
    beside = near_tokens(anchors, "anchor", 5).unionByName(anchors.select(F.col("anchor").alias("a"), F.col("anchor").alias("b")))
    links = _compared(sigs, scratch.write(beside, "anchors"), scratch)

    # full names first, then names with an initial for one of their parts, then names with initials only
    bare = sigs.select(F.col("sig").alias("node"), (F.size("others") == 0).alias("bare"))
    own = sigs.select(F.col("sig").alias("node"))
    pairs = links.join(bare.select(F.col("node").alias("u"), F.col("bare").alias("bare_u")), "u").join(bare.select(F.col("node").alias("v"), F.col("bare").alias("bare_v")), "v")
    pairs = scratch.write(pairs, "links")
    full = connected_components(pairs.filter("kind = 'full' and not bare_u"), scratch, "full")
    short = pairs.filter("kind <> 'full'").select(F.when(F.col("kind") == "first", F.col("u")).otherwise(F.col("v")).alias("short"), F.when(F.col("kind") == "first", F.col("v")).otherwise(F.col("u")).alias("node"), F.when(F.col("kind") == "first", F.col("bare_u")).otherwise(F.col("bare_v")).alias("bare"))
    in_full = own.join(full, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = in_full.groupBy("component").agg(F.count("*").alias("size"))
    # all members of a class must fit one other class, and no other
    part = short.filter("not bare").select("short", "node").join(in_full.withColumnsRenamed({"node": "short", "component": "c"}), "short").join(in_full.withColumnRenamed("component", "into"), "node")
    part = part.groupBy("c").agg(F.count_distinct("short").alias("members"), F.min("into").alias("low"), F.max("into").alias("high")).filter("low = high")
    part = part.join(sizes.withColumnRenamed("component", "c"), "c").filter("members = size").select(F.col("c").alias("u"), F.col("low").alias("v"))
    edges = full.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(part)
    full = connected_components(edges, scratch, "parts")
    in_full = own.join(full, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    fits = short.filter("bare").select("short", "node").join(in_full, "node").groupBy("short").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    fits = scratch.write(fits, "fits")
    joins = fits.filter("low = high").select(F.col("short").alias("u"), F.col("low").alias("v"))
    alone = pairs.filter("kind = 'full' and bare_u").select("u", "v").join(fits.select(F.col("short").alias("u")), "u", "left_anti").join(fits.select(F.col("short").alias("v")), "v", "left_anti")
    edges = full.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(joins).unionByName(alone.select("u", "v"))
    classes = connected_components(edges, scratch, "classes")
    result = named.join(classes.withColumnRenamed("node", "sig"), "sig", "left").withColumn("class_id", F.coalesce("component", "sig"))
    return result.select(F.col("name").alias(name), "mentions", "class_id", F.concat_ws(" ", F.replace("anchor", F.lit(_BOUND), F.lit(" ")), F.array_join("others", " "), "initials").alias("signature"))


def _compared(sigs: DataFrame, anchors: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v, kind``: what ``same_name`` says of the signatures whose anchors are near and that share a key.

    Keys of a full token are its delete neighbourhood, what it may be short for and its first five
    letters; of an initial, and of a full token against initials, the letter. A surname that a third
    of all names hold is thus split by what stands beside it, and hot keys are salted.
    """
    none = F.array().cast("array<string>")
    stands = F.create_map(*(x for short, fulls in NICKNAMES.items() for x in (F.lit(short), F.array(*map(F.lit, sorted(fulls))))))
    parts = F.flatten(F.transform("others", lambda t: F.filter(F.split(t, "-"), lambda p: p != "")))
    whole = F.array_join(parts, "")
    words = F.array_distinct(F.concat(parts, F.when(whole != "", F.array(whole)).otherwise(none)))
    forms = F.array_distinct(F.flatten(F.transform(words, lambda t: F.concat(F.array(t), F.coalesce(F.element_at(stands, t), none)))))
    keys = F.concat(F.flatten(F.transform(forms, _deletes)), F.transform(F.filter(words, lambda t: F.length(t) >= 5), lambda t: F.concat(F.lit("^"), F.substring(t, 1, 5))))
    keys = F.when(F.size("others") > 0, F.array_distinct(keys)).when(F.col("is_group"), F.array(F.lit(""))).otherwise(none)
    letters = F.when(F.col("is_group"), none).otherwise(F.array_distinct(F.transform(forms, lambda t: F.concat(F.lit("="), F.substring(t, 1, 1)))))
    first = F.when(~F.col("is_group") & (F.size("others") == 0), F.array(F.concat(F.lit("="), F.substring("initials", 1, 1)))).otherwise(none)
    fields = ("sig", "is_group", "anchor", "others", "initials")
    keyed = sigs.select(*fields, keys.alias("keys"), letters.alias("letters"), first.alias("first"))
    keyed = scratch.write(keyed, "keyed")
    # one side goes to the anchors near its own
    moved = keyed.join(anchors.withColumnsRenamed({"a": "anchor", "b": "beside"}), "anchor")
    left = moved.select("sig", F.col("beside").alias("anchor"), F.explode(F.concat("keys", "first")).alias("key"))
    right = keyed.select("sig", "anchor", F.explode(F.concat("keys", "first", "letters")).alias("key"))
    hot = left.groupBy("anchor", "key").count().filter(F.col("count") > HOT).select("anchor", "key", F.lit(True).alias("hot"))
    left = left.join(hot, ["anchor", "key"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")).otherwise(0))
    right = right.join(hot, ["anchor", "key"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = left.select("anchor", "key", "salt", F.col("sig").alias("x")).hint("merge").join(right.select("anchor", "key", "salt", F.col("sig").alias("y")), ["anchor", "key", "salt"])
    met = met.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    met = met.join(sigs.select(*(F.col(c).alias(f"{c}_1") for c in fields)), F.col("u") == F.col("sig_1")).join(sigs.select(*(F.col(c).alias(f"{c}_2") for c in fields)), F.col("v") == F.col("sig_2"))

    @F.pandas_udf("string")
    def same(group: pd.Series, a: pd.Series, ao: pd.Series, ai: pd.Series, b: pd.Series, bo: pd.Series, bi: pd.Series) -> pd.Series:
        return pd.Series([same_name(g, [x, *xo], xi, [y, *yo], yi) for g, x, xo, xi, y, yo, yi in zip(group, a, ao, ai, b, bo, bi, strict=True)], dtype=object)

    kind = same("is_group_1", "anchor_1", "others_1", "initials_1", "anchor_2", "others_2", "initials_2")
    met = met.filter("is_group_1 = is_group_2").select("u", "v", kind.alias("kind"))
    return scratch.write(met, "met").filter("kind <> ''")


def linked_pairs(classes: DataFrame, name: str) -> DataFrame:
    """``name_1, name_2`` (smaller first): all pairs of spellings within a class."""
    left = classes.select("class_id", F.col(f"`{name}`").alias("name_1"))
    return left.join(classes.select("class_id", F.col(f"`{name}`").alias("name_2")), "class_id").filter("name_1 < name_2").select("name_1", "name_2")
