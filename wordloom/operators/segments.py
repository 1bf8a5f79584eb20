"""Labelled spans of a text (V01-V14): rule matches, block quotes, overlap resolution, gapless cover, metrics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = ("User_Original_Content", "low", "floor")
# Ranks by which overlaps are decided, the least first.
LABEL_RANK = {"Moderation_Notice": 0, "Prompt_Reproduction": 1, "Direct_Quote_Of_Model": 2, "Paraphrase_Of_Model": 3}
CONFIDENCE_RANK = {"high": 0, "medium": 1, "low": 2}
SPANS = "array<struct<start:int,end:int,label:string,confidence:string,source:string>>"


@dataclass(frozen=True)
class Rule:
    """``scope``: a rule may hold for whole rows, for spans, or for both."""

    name: str
    pattern: str
    label: str
    confidence: str
    scope: str = "both"


_NOTICE, _PROMPT, _DIRECT, _PARA = LABEL_RANK
# who speaks, in our own words
_IT = r"(?:it|(?:the|this|that|my|our|your) (?:new |old |whole )?(?:bot|assistant|model|chatbot|ai|tutor|chat|client|tool|writing coach|second account|story thread|memory feature)|claude|gpt|gemini|copilot)"
_SAID = r"(?:says?|said|writes?|wrote|replie[sd]|reply|answers?|answered|responds?|responded|told me|tells me)"
_OPEN, _SHUT, _IN = r"[\"“«]", r"[\"”»]", r"[^\"”»\n]"
_ILL = r"(?:manic|delusional|paranoid|psychotic|unwell|in crisis|a patient|mentally ill|unstable|detached from reality|spiralling|spiraling)"
_HELP = r"(?:professional help|(?:see|seek|talk to|speak to|find|call) (?:a |my |some )?(?:professional|therapist|doctor|counsell?or|help|hotline)|therapy|a break|rest)"
_REST = r"[^.!?\n]*"

#: The catalogue: rule names, labels and confidences are those of the inventory, the patterns are our own. Order decides: the first match
#: labels a row, and earlier spans win ties. Rules are data, pass others as you like.
RULES = (
    *(
        Rule(n, r"(?i)" + p, _NOTICE, "high")
        for n, p in (
            ("notice_automatic", r"\bthis (?:action|message|comment|post) was (?:performed|made|posted|written) (?:automatically|by a script|by a bot)\b"),
            ("notice_i_am_a_bot", r"\bi am (?:only )?a (?:ro)?bot\b"),
            ("notice_script", r"\bposted by a script\b"),
            ("notice_contact", r"\b(?:contact|message|ask) (?:the )?mod(?:erator)?s\b"),
            ("notice_removed", r"\byour (?:post|comment|submission) (?:was|has been) removed\b"),
            ("notice_rules", r"\bplease (?:read|review|follow) (?:the|our) (?:sub |community )?rules\b"),
            ("notice_reminder", r"\breminder: (?:this|we|our) (?:sub|community|board)\b"),
            ("notice_thanks", r"\bthank you for (?:your submission|posting (?:to|in))\b"),
            ("notice_locked", r"\bthis (?:thread|post) (?:is|has been) locked\b"),
            ("notice_flair", r"\bplease (?:add|choose|set) a flair\b"),
            ("notice_megathread", r"\bplease (?:use|post in) the megathread\b"),
            ("notice_questions", r"\bif you have (?:any )?questions or concerns\b"),
        )
    ),
    *(
        Rule(n, f"({f})" + p, _PROMPT, c, k)
        for n, f, p, c, k in (
            ("prompt_tag_block", "?is", r"<\w*reminders?\w*>.*?</\w*reminders?\w*>", "high", "both"),
            ("prompt_tag_open", "?i", r"</?\w+_(?:conversation_)?reminders?>", "high", "both"),
            ("prompt_avoid_praise", "?i", r"\bnever (?:starts|begins?) (?:its|a|the) (?:response|reply|answer)s? by (?:saying|praising|calling)\b" + _REST, "high", "both"),
            ("prompt_no_emoji", "?i", r"\bdoes not use emojis? unless\b" + _REST, "high", "both"),
            ("prompt_no_actions", "?i", r"\bavoids? the use of (?:emotes|actions) inside asterisks\b" + _REST, "high", "both"),
            ("prompt_critical", "?i", r"\bcritically evaluates? (?:any )?theor(?:y|ies), claims? (?:and|or) ideas?\b" + _REST, "high", "both"),
            ("prompt_signs", "?i", r"\bif (?:the assistant|it) notices signs? (?:that|of)\b" + _REST, "high", "both"),
            ("prompt_symptoms", "?i", r"\b(?:mania|psychosis), (?:mania|psychosis|dissociation)\b" + _REST, "high", "both"),
            ("prompt_honest_feedback", "?i", r"\bprovides? honest and accurate feedback\b" + _REST, "high", "both"),
            ("prompt_role_play_break", "?i", r"\bbreaks? character (?:to|when|if)\b" + _REST, "high", "both"),
            ("prompt_vigilant", "?i", r"\bremains? vigilant for\b" + _REST, "high", "span"),
            ("prompt_long_chat", "?i", r"\b(?:in|over) (?:very )?long (?:conversations?|chats?), (?:the assistant|it) (?:may|should|must)\b" + _REST, "medium", "span"),
        )
    ),
    Rule("blockquote_marker", r"(?m)^[ \t]*(?:>|&gt;)", _DIRECT, "high", "row"),
    *(
        Rule(n, "(?i)" + p, label, c)
        for n, label, c, p in (
            ("attribution_phrase_open_quote", _DIRECT, "high", rf"\b{_IT} (?:just |then |even |literally )?{_SAID}[:,]? {_OPEN}{_IN}{{3,400}}{_SHUT}"),
            ("standalone_speaker_label", _DIRECT, "high", r"(?m)^(?:claude|gpt|chatgpt|assistant|bot|ai|model)[ \t]*:[ \t]*[^\n]+"),
            ("speaker_label_colon_quote", _DIRECT, "high", rf"\b(?:claude|gpt|assistant|bot|ai|model): ?{_OPEN}{_IN}{{3,400}}{_SHUT}"),
            ("attribution_phrase_quoted_block", _DIRECT, "high", rf"\b(?:here is|this is|all i got was|the (?:reply|answer|response) was|i quote|its exact words(?: were)?|the next line held the words)[:,]? {_OPEN}?{_IN}{{3,400}}{_SHUT}?"),
            ("lcr_model_self_attribution_pathologizing", _PARA, "high", rf"\b{_IT} (?:thinks|decided|assumed|insisted|implied|suggested|believes) (?:that )?i(?:'m|’m| am| was| might be| may be) (?:\w+ )?{_ILL}{_REST}"),
            ("lcr_user_quotation_model_utterance", _PARA, "high", rf"\b(?:it|they) (?:put|used|held|called) (?:\w+ )?(?:the words? )?{_OPEN}{_IN}{{3,200}}{_SHUT}"),
            ("lcr_basically_said", _PARA, "high", rf"\b{_IT} basically (?:said|told me|called me) {_REST}{_ILL}"),
            ("lcr_kept_telling_me_indirect", _PARA, "high", rf"\b(?:kept|keeps) (?:on )?telling me (?:that |to ){_REST}"),
            ("my_claude_tells_me", _PARA, "high", rf"\bmy (?:claude|gpt|assistant|bot|chatbot) (?:tells|told|keeps telling) me{_REST}"),
            ("mine_is_telling", _PARA, "high", rf"\bmine (?:is|was|keeps|kept) (?:telling|saying|insisting|asking|warning){_REST}"),
            ("third_person_self_attribution", _PARA, "high", rf"\b{_IT} (?:said|claimed|insisted|told me) (?:that )?(?:it|as an ai)(?:'s|’s| is| was| could| would| can)?n?o?t? {_REST}"),
            ("lcr_directive_help_attribution", _PARA, "high", rf"\b(?:told|urged|asked|advised|begged|wanted|ordered) me to {_REST}{_HELP}"),
            ("lcr_refusal_attribution", _PARA, "high", rf"\b{_IT} (?:refused|declined|was unwilling|would not agree) to {_REST}"),
            ("lcr_diagnostic_attribution", _PARA, "high", rf"\b(?:diagnosed|labell?ed|pathologi[sz]ed|psychoanaly[sz]ed) (?:me|my){_REST}"),
            ("lcr_concern_expression_attribution", _PARA, "high", rf"\b(?:expressed|voiced|raised|showed) (?:its |deep |genuine |some )?concerns? (?:about|for|over){_REST}"),
            ("basically_said", _PARA, "high", rf"\b{_IT} (?:basically|essentially|more or less|pretty much) {_SAID}{_REST}"),
            ("attribution_verb_directive", _PARA, "medium", rf"\b{_IT} (?:told|asked|warned|advised|reminded|urged|lectured|scolded) me{_REST}"),
            ("is_like_reported_speech", _PARA, "medium", rf"\b{_IT} (?:is|was|goes|went) (?:all )?like[,: ]{_REST}"),
            ("narrative_reconstruction", _PARA, "medium", rf"\b(?:then|so|suddenly|and) {_IT} (?:began|started|proceeded|went on) (?:to |\w+ing){_REST}"),
            ("model_judgment_attribution", _PARA, "medium", r"\btreat(?:s|ed|ing)? me (?:like|as) [^.!?,\n]{3,100}"),
            ("would_say", _PARA, "medium", rf"\b{_IT} (?:would|will|used to) (?:say|tell|reply|answer|write){_REST}"),
            ("lcr_keeps_suggesting", _PARA, "high", rf"\b(?:kept|keeps) (?:on )?(?:suggesting|recommending|pushing|warning|reminding|asking|urging){_REST}"),
            ("i_asked_and_it_said", _PARA, "medium", rf"\bi asked [^.!?\n]{{0,120}}(?:and|but) it {_SAID}{_REST}"),
            ("lcr_suddenly_started", _PARA, "medium", rf"\b(?:suddenly|out of nowhere|all at once|halfway through)[, ]+{_IT} (?:started|began|turned|switched|shifted|changed){_REST}"),
            ("repeated_attribution_adverb", _PARA, "medium", rf"\b{_IT} (?:always|constantly|repeatedly|keeps|again and again|over and over) (?:says?|said|tells?|told|asks?|asked|warns?|warned|reminds?|reminded){_REST}"),
            ("claude_telling_users", _PARA, "high", rf"\b(?:claude|gpt|the bot|the model) (?:is|was|started|keeps) telling (?:users|people|everyone|us){_REST}"),
            ("lcr_flip_vocabulary", _PARA, "medium", rf"\b{_IT} (?:suddenly )?(?:flipped|switched|changed its tone|turned cold|turned stern|did a one eighty|contradicted itself|pushed back){_REST}"),
            ("lcr_straight_up_told", _PARA, "medium", rf"\b(?:straight up|flat out|outright) (?:told|called|said){_REST}"),
            ("weak_habitual_attribution", _PARA, "low", rf"\b{_IT} (?:tends|likes|loves) to {_REST}"),
            ("weak_tells_me_pathologizing", _PARA, "low", rf"\btells? me {_REST}{_ILL}"),
            ("weak_indirect_model_behavior", _PARA, "low", rf"\b{_IT} (?:joked|walked away|lost track|stayed calm|second guessed|lectured|praised|shortened|flagged|dramati[sz]ed|ignored|forgot|rewrote){_REST}"),
            ("weak_is_like_with_quote", _DIRECT, "low", rf"\blike,? {_OPEN}{_IN}{{3,200}}{_SHUT}"),
            ("weak_lcr_community_abbreviation", _PARA, "low", rf"\blcrs?\b{_REST}"),
        )
    ),
)
_QUOTE = re.compile(r"(?m)^[ \t]*(?:>|&gt;)[^\n]*(?:\n[ \t]*(?:>|&gt;)[^\n]*)*\n?")


def classify(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule that matches a whole row gives label, confidence and source; none gives the floor."""
    hit = lambda r: F.struct(F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence"), F.lit(r.name).alias("source"))
    out = F.struct(F.lit(FLOOR[0]).alias("label"), F.lit(FLOOR[1]).alias("confidence"), F.lit("regex_default").alias("source"))
    for r in reversed([r for r in rules if r.scope != "span"]):
        out = F.when(text.rlike(r.pattern), hit(r)).otherwise(out)
    return out


def classify_sql(text: str, rules: tuple[Rule, ...] = RULES) -> tuple[str, str, str]:
    """``classify`` as three ANSI expressions, for holding it against another engine."""
    row = [r for r in rules if r.scope != "span"]
    when = lambda value, floor: "CASE " + " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(text, r.pattern.replace("'", "''"), value(r)) for r in row) + f" ELSE '{floor}' END"
    return when(lambda r: r.label, FLOOR[0]), when(lambda r: r.confidence, FLOOR[1]), when(lambda r: r.name, "regex_default")


def raw_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str, str, str]]:
    """All matches of all rules and block quotes, in order of emission; a notice covers the whole text.

    A block quote is a prompt's reproduction if a rule for those matches in it, else the model's words.
    """
    span = [(r, re.compile(r.pattern)) for r in rules if r.scope != "row"]
    for r, p in span:
        if r.label == _NOTICE and p.search(text):
            return [(0, len(text), r.label, r.confidence, r.name)]
    prompts = [(r, p) for r, p in span if r.label == _PROMPT]
    out = [(m.start(), m.end(), r.label, r.confidence, r.name) for r, p in prompts for m in p.finditer(text) if m.group()]
    for m in _QUOTE.finditer(text):
        of = next((r for r, p in prompts if p.search(m.group())), None)
        out.append((m.start(), m.end(), of.label if of else _DIRECT, "high", f"blockquote:{of.name}" if of else "blockquote"))
    return out + [(m.start(), m.end(), r.label, r.confidence, r.name) for r, p in span if r.label not in (_PROMPT, _NOTICE) for m in p.finditer(text) if m.group()]


def cover(length: int, spans: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """Gapless cover of a text: the best ranked span wins each stretch, the earlier one on ties; the rest is the floor."""
    if not length:
        return [(0, 0, *FLOOR)]
    cuts = sorted({0, length, *(x for s in spans for x in s[:2])})
    out: list[tuple[int, int, str, str, str]] = []
    for a, b in zip(cuts, cuts[1:]):
        over = [(LABEL_RANK.get(s[2], 9), CONFIDENCE_RANK.get(s[3], 9), i) for i, s in enumerate(spans) if s[0] <= a and s[1] >= b]
        what = spans[min(over)[2]][2:] if over else FLOOR
        if out and out[-1][2:] == what:
            out[-1] = (out[-1][0], b, *what)
        else:
            out.append((a, b, *what))
    return out


def segment(df: DataFrame, text: str, key: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, span_index, span_start, span_end, label, confidence, source, span_text: gapless spans; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *s, (t or "")[s[0] : s[1]]) for k, t in zip(pdf["k"], pdf["t"]) for i, s in enumerate(cover(len(t or ""), raw_spans(t or "", rules)))]
            yield pd.DataFrame(rows, columns=["k", "span_index", "span_start", "span_end", "label", "confidence", "source", "span_text"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, span_index int, span_start int, span_end int, label string, confidence string, source string, span_text string")
    return out.withColumnRenamed("k", key)


def resolve(spans: DataFrame, key: str) -> DataFrame:
    """The cover in SQL terms, for spans that are rows (key, length, start, end, label_rank, conf_rank, ord): who wins each stretch.

    A sweep: a span meets only the stretches between the boundaries that lie in it, which it gets by slicing the sorted
    boundaries of its key, so no stretch is held against a span that doesn't cover it.
    """
    cuts = spans.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array(F.lit(0), "length", "start", "end"))))).alias("cuts"), F.min("ord").alias("first"))
    rank = F.struct("label_rank", "conf_rank", "ord")
    low, high = F.array_position("cuts", F.col("start")).cast("int"), F.array_position("cuts", F.col("end")).cast("int")
    held = F.transform(F.slice("cuts", low, F.greatest(high - low, F.lit(0))), lambda lo: F.struct(lo.alias("lo"), rank.alias("rank")))
    # the first span of a key also brings its stretches that no span may cover; all that follows is partitioned by the key
    every = F.when(F.col("ord") == F.col("first"), F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda lo: F.struct(lo.alias("lo"), F.when(F.lit(False), rank).alias("rank"))))
    own = spans.join(cuts, key).select(key, F.element_at("cuts", -1).alias("last"), F.explode(F.when(every.isNull(), held).otherwise(F.concat(held, every))).alias("x"))
    best = own.groupBy(key, "x.lo").agg(F.min("x.rank")["ord"].alias("winner"), F.max("last").alias("last"))
    w = Window.partitionBy(key).orderBy("lo")
    new = F.when(F.col("winner").eqNullSafe(F.lag("winner").over(w)) & (F.col("lo") > 0), 0).otherwise(1)
    runs = best.withColumns({"hi": F.coalesce(F.lead("lo").over(w), F.col("last")), "run": new})
    runs = runs.withColumn("run", F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("winner").alias("winner")).select(key, "lo", "hi", "winner")


def metrics(spans: DataFrame) -> DataFrame:
    """label, confidence, spans, chars and their share of all characters."""
    n = F.col("span_end") - F.col("span_start")
    g = spans.groupBy("label", "confidence").agg(F.count(F.lit(1)).alias("spans"), F.sum(n).alias("chars"))
    return g.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy()), 4))


def dominant(spans: DataFrame, key: str) -> DataFrame:
    """The label other than the floor with the most characters of each row, else the floor."""
    g = spans.groupBy(key, "label").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n"))
    own = F.when(F.col("label") != FLOOR[0], F.struct(F.col("n"), F.col("label")))
    return g.groupBy(key).agg(F.coalesce(F.max(own)["label"], F.lit(FLOOR[0])).alias("dominant"))


def tiers(spans: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """Tier 1 where one reliable span of the model's words covers at least ``share`` of the row."""
    n = F.max("span_end").over(Window.partitionBy(key))
    d = spans.withColumn("part", F.when(F.col("label").isin("Direct_Quote_Of_Model", "Paraphrase_Of_Model") & F.col("confidence").isin("high", "medium") & (n > 0), (F.col("span_end") - F.col("span_start")) / n).otherwise(0.0))
    return d.groupBy(key).agg(F.when(F.max("part") >= share, 1).otherwise(2).alias("tier"))


def breakdown(spans: DataFrame, dims: list[str], gate: float = 0.7) -> DataFrame:
    """dim, value, label, confidence, spans, chars, reliable, passes, for all rows and each value of ``dims``.

    ``reliable`` is the share of the value's characters in spans of high or medium confidence, ``passes`` whether it reaches the gate.
    """
    n = F.col("span_end") - F.col("span_start")
    d = F.explode(F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")), *[F.struct(F.lit(x).alias("dim"), F.coalesce(F.col(x).cast("string"), F.lit("unknown")).alias("value")) for x in dims])).alias("d")
    g = spans.select(d, "label", "confidence", n.alias("n")).groupBy("d.dim", "d.value", "label", "confidence").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("chars"))
    own = Window.partitionBy("dim", "value")
    sure = F.sum(F.when(F.col("confidence").isin("high", "medium"), F.col("chars")).otherwise(0)).over(own)
    return g.withColumn("reliable", F.round(F.when(F.sum("chars").over(own) > 0, sure / F.sum("chars").over(own)).otherwise(0.0), 4)).withColumn("passes", F.col("reliable") >= gate)


def budget(df: DataFrame, stratum: str, n: int, boost: tuple[str, str] | None = None) -> DataFrame:
    """stratum, rows, quota: ``n`` calls shared in proportion, none above its rows; what is cut goes to the strata with rows left, the largest first.

    ``boost``: a column and a value whose rows get ``n // 5`` calls of their own before, as stratum ``boost``.
    """
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("unknown"))
    if boost:
        s = F.when(F.col(boost[0]) == boost[1], "boost").otherwise(s)
    sizes = df.groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))
    extra = n // 5 if boost else 0
    rest = F.sum(F.when(F.col("stratum") != "boost", F.col("rows")).otherwise(0)).over(Window.partitionBy())
    first = F.when(F.col("stratum") == "boost", F.least(F.lit(extra), F.col("rows"))).otherwise(F.least(F.col("rows"), F.floor((n - extra) * F.col("rows") / rest)))
    g = sizes.withColumn("first", first.cast("long"))
    over = F.lit(n) - F.sum("first").over(Window.partitionBy())  # one row a stratum
    room = F.col("rows") - F.col("first")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("rows"), "stratum")
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("room", room).withColumn("over", over).withColumn("before", before).select("stratum", "rows", (F.col("first") + F.greatest(F.lit(0), F.least(F.col("room"), F.col("over") - F.col("before")))).alias("quota"))


def quota_sample(df: DataFrame, key: str, label: str, quotas: dict[str, int], n: int, *, boost: Column | None = None, split: str | None = None, seed: str = "42") -> DataFrame:
    """At most ``n`` rows with their stage: 1, the quota of each label; 2, boosted rows; 3, any row; in order of md5.

    With ``split`` a label's quota is shared between that column's values in proportion, rounded down, at least one.  Only the first ``n`` rows of
    a label and value can be taken in any stage, so no label is sorted as a whole.
    """
    from wordloom.operators.relational import hash_order

    boosted = F.coalesce(boost, F.lit(False)) if boost is not None else F.lit(False)
    by = [label, *([split] if split else [])]
    rows = df.withColumns({"__h": hash_order(key, seed), "__b": boosted})
    quota = F.coalesce(*[F.when(F.col(label) == k, v) for k, v in quotas.items()], F.lit(0))
    if split:
        g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("g")).withColumn("all", F.sum("g").over(Window.partitionBy(label)))
        g = g.select(*(F.col(c).alias(f"__{c}") for c in by), F.greatest(F.lit(1), F.floor(quota * F.col("g") / F.col("all"))).alias("__q"))
        on = [rows[c].eqNullSafe(g[f"__{c}"]) for c in by]
        rows = rows.join(F.broadcast(g), on[0] & on[1]).drop(*(f"__{c}" for c in by))  # a row for each label and value
    else:
        rows = rows.withColumn("__q", quota)
    w = Window.partitionBy(*by, "__b").orderBy("__h", key)  # boosted rows apart, so that the cut keeps enough of both
    near = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    near = near.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h", key)))  # at most 2 n rows each
    stage = F.when(F.col("__r") <= F.col("__q"), 1).when(F.col("__b"), 2).otherwise(3)
    return near.withColumn("stage", stage).orderBy("stage", "__h", key).limit(n).select(*df.columns, "stage")


def rescored(spans: DataFrame, key: str, scorer: Callable[[list[str]], list[tuple[str, str]]] | None, calls: int = 0) -> DataFrame:
    """Spans of the floor given to a scorer, which gives a label and a confidence for each text.

    ``scorer`` runs in the workers, a batch at a time; ``calls`` is the budget of texts over all, taken in order of md5 of key and
    index.  The default budget is 0, and without a scorer nothing changes.  An answer that isn't a known label and
    confidence, or an error, leaves the floor.
    """
    if scorer is None or calls <= 0:
        return spans
    from wordloom.operators.relational import hash_order

    ident = F.concat_ws("|", F.col(key).cast("string"), F.col("span_index").cast("string"))
    picked = spans.where((F.col("label") == FLOOR[0]) & (F.col("span_text") != "")).withColumn("__id", ident).orderBy(hash_order("__id", "42"), "__id").limit(calls)
    labels = {*LABEL_RANK, FLOOR[0]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                answers = list(scorer(pdf["span_text"].tolist()))
            except Exception:  # noqa: BLE001 - whatever a scorer raises, its spans keep the floor
                answers = []
            answers += [FLOOR[:2]] * (len(pdf) - len(answers))
            sure = [a if tuple(a)[0] in labels and tuple(a)[1] in CONFIDENCE_RANK else FLOOR[:2] for a in answers[: len(pdf)]]
            yield pd.DataFrame({"__id": pdf["__id"], "__label": [a[0] for a in sure], "__conf": [a[1] for a in sure]})

    scored = picked.select("__id", "span_text").mapInPandas(run, "__id string, __label string, __conf string")
    x = spans.withColumn("__id", ident).join(scored, "__id", "left")
    hit = F.col("__label").isNotNull() & (F.col("__label") != FLOOR[0])
    return x.withColumns({"label": F.when(hit, F.col("__label")).otherwise(F.col("label")), "confidence": F.when(hit, F.col("__conf")).otherwise(F.col("confidence")), "source": F.when(hit, F.lit("scorer")).otherwise(F.col("source"))}).drop("__id", "__label", "__conf")
