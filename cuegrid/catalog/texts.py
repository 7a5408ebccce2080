"""Queries for text operators and scene planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid import params as P
from cuegrid.catalog import tables as T
from cuegrid.catalog.base import block, query
from cuegrid.functions import text as X
from cuegrid.functions.scalars import count_words
from cuegrid.operators import scenes as SC
from cuegrid.operators.rows import unfold
from cuegrid.operators.subtitles import build_cues, cue_blocks

C = F.col


@query("x1_normalize", "SELECT doc_id AS script_id, t AS text FROM norm", "norm")
def normalize(spark, folder):
    return T.scripts(spark, folder).select("script_id", X.normalize_script(C("text")).alias("text"))


block("conv", """
  SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id""")
for _name in ("norm", "blk", "pblk", "pars", "pieces", "sents"):
    from cuegrid.catalog.base import _BLOCKS

    _needs, _body = _BLOCKS[_name]
    for _other in ("norm", "blk", "pblk", "pars", "pieces"):
        _body = _body.replace(f"FROM {_other}", f"FROM c_{_other}")
    _body = _body.replace("FROM documents", "FROM conv")
    block("c_" + _name, _body, *(["conv"] + ["c_" + n for n in _needs]))


def _dialogues(spark, folder):
    """Conversations as scripts of one paragraph a turn; a script is as long as its conversation."""
    turn = F.struct("turn", "text")
    return T.spread(T.table(spark, folder, "conversations")).groupBy(C("conv_id").alias("script_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["text"]), "\n\n").alias("text"))


@query("x2_paragraphs", "SELECT doc_id AS script_id, paragraph, p AS text FROM c_pars", "c_pars")
def paragraphs(spark, folder):
    return unfold(_dialogues(spark, folder), X.split_paragraphs(C("text")), "paragraph", "text", "script_id")


@query("x3_sentences", "SELECT script_id, sent_ix, text FROM sents", "sents")
def sentences(spark, folder):
    return T.sentences(spark, folder).select("script_id", "sent_ix", "text")


@query("x4_abbreviations", r"""
  SELECT doc_id AS script_id, len(list_filter(ws, lambda w: regexp_matches(w,
    '^["''(“‘]*(?:(?i:""" + T._ABBR + r""")|\p{Lu}|(?:[a-zA-Z]\.)+[a-zA-Z])\.$'))) AS n
  FROM (SELECT doc_id, """ + T.sql_words("text") + """ AS ws FROM documents)""")
def abbreviations(spark, folder):
    return T.scripts(spark, folder).select("script_id", F.size(F.filter(
        X.words_of(C("text")), X.ends_with_abbreviation)).alias("n"))


@query("x5_long_sentences", f"""
  SELECT script_id, sent_ix, array_to_string({T.sql_words('text')}, ' ') AS joined FROM sents""", "sents")
def long_sentences(spark, folder):
    chunks = X.split_long_sentence(C("text"), 5.0)
    return T.sentences(spark, folder).select("script_id", "sent_ix", F.array_join(
        X.words_of(F.array_join(chunks, " ")), " ").alias("joined"))


@query("x6_units", f"""
  SELECT script_id, paragraph, array_to_string({T.sql_words("string_agg(text, ' ' ORDER BY sent_ix)")}, ' ') AS joined,
    sum(len(regexp_extract_all(text, '[A-Za-z0-9À-ɏ'']+')))::BIGINT AS words
  FROM c_sents GROUP BY ALL""", "c_sents")
def units(spark, folder):
    rows = _dialogues(spark, folder).select("script_id", X.split_units(C("text")).alias("u"))
    parts = F.transform(F.array_distinct(F.transform("u", lambda x: x["paragraph"])), lambda p: F.struct(
        p.alias("paragraph"), F.filter("u", lambda x: x["paragraph"] == p).alias("us")))
    return rows.select("script_id", F.explode(parts).alias("p")).select(
        "script_id", "p.paragraph",
        F.array_join(X.words_of(F.array_join(F.transform("p.us", lambda x: x["text"]), " ")), " ").alias("joined"),
        F.aggregate("p.us", F.lit(0).cast("bigint"), lambda a, x: a + x["words"]).alias("words"))


_LINES = """
  SELECT script_id, scene_ix, j, unnest(list_reduce(list_transform(ws, lambda w: {'l': [w]}),
    lambda a, x: CASE WHEN length(a.l[-1]) + 1 + length(x.l[1]) > room THEN {'l': list_append(a.l, x.l[1])}
      ELSE {'l': list_append(a.l[:-2], a.l[-1] || ' ' || x.l[1])} END).l) AS line,
    generate_subscripts(list_reduce(list_transform(ws, lambda w: {'l': [w]}),
    lambda a, x: CASE WHEN length(a.l[-1]) + 1 + length(x.l[1]) > room THEN {'l': list_append(a.l, x.l[1])}
      ELSE {'l': list_append(a.l[:-2], a.l[-1] || ' ' || x.l[1])} END).l, 1) AS k
  FROM (SELECT script_id, scene_ix, j, """ + T.sql_words("u") + """ AS ws,
      least(84::DOUBLE, length(u) / ceil(length(u) / 84) * 1.15::DOUBLE) AS room
    FROM (SELECT script_id, scene_ix, us[j] AS u, j FROM (SELECT script_id, scene_ix, """ + T.sql_split("text") + """ AS us FROM scn),
      unnest(range(1, len(us) + 1)) r(j)))"""
block("cue", _LINES, "scn")


@query("x7_cue_lines", """
  SELECT script_id, scene_ix, row_number() OVER (PARTITION BY script_id, scene_ix ORDER BY j, k) - 1 AS ix, line
  FROM cue""", "cue")
def cue_lines(spark, folder):
    return unfold(T.scenes(spark, folder), X.cue_lines(C("text")), "ix", "line", "script_id", "scene_ix")


@query("x8_subtitles", f"""
  SELECT script_id, cue_ix, cue_ix || chr(10) || {{a}} || ' --> ' || {{b}} || chr(10) || line || chr(10) AS block FROM (
    SELECT script_id, line, row_number() OVER (PARTITION BY script_id ORDER BY scene_ix, j, k) AS cue_ix,
      round_even((off + speech * before / total) * 1000, 0)::BIGINT AS a,
      round_even((off + speech * (before + length(line)) / total) * 1000, 0)::BIGINT AS b
    FROM (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY script_id, scene_ix ORDER BY j, k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(length(line)) OVER (PARTITION BY script_id, scene_ix) AS total FROM cue)
    JOIN (SELECT script_id, scene_ix, 2.0::DOUBLE + length(text) % 7 AS speech, coalesce(sum(3.0::DOUBLE + length(text) % 7)
        OVER (PARTITION BY script_id ORDER BY scene_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM scn) USING (script_id, scene_ix))""".format(
    a="printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000)",
    b="printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000)"), "cue", "scn")
def subtitles(spark, folder):
    rows = T.scenes(spark, folder).select(
        "script_id", "scene_ix", "text", (F.lit(2.0) + F.length("text") % 7).alias("speech"),
        (F.lit(3.0) + F.length("text") % 7).alias("rendered"))
    return cue_blocks(build_cues(rows))


@query("x9_share_words", f"""
  SELECT script_id, scene_ix, array_to_string(w[1:a], ' ') AS p1, array_to_string(w[a + 1:a + b], ' ') AS p2,
    array_to_string(w[a + b + 1:], ' ') AS p3
  FROM (SELECT script_id, scene_ix, {T.sql_words('text')} AS w, round_even(len({T.sql_words('text')}) * 8.0::DOUBLE / 18, 0)::INT AS a,
    round_even(len({T.sql_words('text')}) * 6.0::DOUBLE / 18, 0)::INT AS b FROM scn)""", "scn")
def share_words(spark, folder):
    parts = X.share_words(C("text"), F.array(F.lit(8.0), F.lit(6.0), F.lit(4.0)))
    return T.scenes(spark, folder).select("script_id", "scene_ix", parts.alias("p")).select(
        "script_id", "scene_ix", *[F.get("p", F.lit(i)).alias(f"p{i + 1}") for i in range(3)])


#: A lexicon the invented words of the corpus can match (rules in the order they apply).
CORPUS_PATTERNS = (("enumeration", r"(?:^|[.!?]\s+)(?:un|the|die|el)"), ("emphasis", r"(ention|tion)"),
                   ("contrast", r"(and|und|ou)"))
block("cued", r"""
  SELECT *, CASE WHEN scene_ix = 0 THEN 'opening' WHEN scene_ix = n_scenes - 1 AND n_scenes > 2 THEN 'closing'
    WHEN regexp_matches(text, '\?\s*$') THEN 'question'
    WHEN regexp_matches(text, '(?i)(?:^|[.!?]\s+)(?:un|the|die|el)') THEN 'enumeration'
    WHEN regexp_matches(text, '(?i)(ention|tion)') THEN 'emphasis'
    WHEN regexp_matches(text, '(?i)(and|und|ou)') THEN 'contrast' END AS cue FROM scn""", "scn")


@query("x10_classify_cues", "SELECT script_id, scene_ix, cue FROM cued", "cued")
def classify_cues(spark, folder):
    return T.scenes(spark, folder).select("script_id", "scene_ix", X.classify_cue(
        C("text"), C("scene_ix"), C("n_scenes"), CORPUS_PATTERNS).alias("cue"))


_NEUTRAL = ", ".join(f"'{n}'" for n, _ in SC.NEUTRAL_ACTIONS)


@query("w18_gesture_rotation", f"""
  SELECT script_id, i - 1 AS scene_ix, gs[i] AS gesture FROM (
    SELECT script_id, list_reduce(list_transform(list(cue ORDER BY scene_ix), lambda c: {{'o': [coalesce(c, '')], 'n': 0}}),
      lambda a, x: CASE
        WHEN x.o[1] <> '' AND m[x.o[1]] <> coalesce(a.o[-1], '') THEN {{'o': list_append(a.o, m[x.o[1]]), 'n': a.n}}
        WHEN ns[a.n % 8 + 1] <> coalesce(a.o[-1], '') THEN {{'o': list_append(a.o, ns[a.n % 8 + 1]), 'n': a.n + 1}}
        ELSE {{'o': list_append(a.o, ns[(a.n + 1) % 8 + 1]), 'n': a.n + 2}} END,
      {{'o': []::VARCHAR[], 'n': 0}}).o AS gs
    FROM (SELECT *, MAP {{'opening': 'welcome', 'closing': 'closing', 'question': 'question', 'enumeration': 'counting',
      'emphasis': 'emphasis', 'contrast': 'contrast'}} AS m, [{_NEUTRAL}] AS ns FROM cued)
    GROUP BY script_id, m, ns), unnest(range(1, len(gs) + 1)) r(i)""", "cued")
def gesture_rotation(spark, folder):
    rows = T.sentence_arrays(spark, folder).where(F.size("sents") > 0)
    n = F.ceil(F.size("sents") / 2).cast("int")
    cues = F.transform(F.sequence(F.lit(0), n - 1), lambda i: X.classify_cue(
        F.array_join(F.slice("sents", i * 2 + 1, F.lit(2)), " "), i, n, CORPUS_PATTERNS))
    return unfold(rows, SC.assign_gestures(cues), "scene_ix", "gesture", "script_id")


TEMPLATE = "ACTION: {{VISUAL_ACTION}}\n\n\n\n{{PRESENTER_DESCRIPTION}}\n{{DIALOGUE}}"


@query("x11_render_prompt", """
  SELECT script_id, scene_ix, 'ACTION: nods' || chr(10) || chr(10) || CASE WHEN script_id % 2 = 0
    THEN 'Clothing: grey blazer. Framing: medium, eye level.' ELSE 'Clothing: grey blazer. Setting: studio.' END
    || chr(10) || 'The presenter says: "' || replace(text, '"', '''') || '"' AS prompt FROM scn""", "scn")
def render_prompt(spark, folder):
    even = C("script_id") % 2 == 0
    fields = {"clothing": F.lit("grey blazer"), "background": F.when(~even, "studio"), "lighting": F.lit(""),
              "shot": F.when(even, "medium"), "camera_position": F.when(even, "eye level").otherwise("")}
    return T.scenes(spark, folder).select("script_id", "scene_ix", X.render_prompt(
        F.lit(TEMPLATE), X.describe_presenter(fields), F.lit("nods"), C("text")).alias("prompt"))


@query("x12_matching_text", f"""
  SELECT doc_id AS script_id, lower(array_to_string({T.sql_words("translate(text, '\"“”’', '''''''''')")}, ' ')) AS norm
  FROM documents""")
def matching_text(spark, folder):
    return T.scripts(spark, folder).select("script_id", X.matching_text(C("text")).alias("norm"))


@query("x13_matching_words", f"""
  SELECT script_id, sent_ix, array_to_string(list_transform({T.sql_words('text')}, lambda w: regexp_replace(
    replace(lower(w), '’', ''''), '[^a-z0-9'']', '', 'g')), ' ') AS words FROM sents""", "sents")
def matching_words(spark, folder):
    return T.sentences(spark, folder).select("script_id", "sent_ix", F.array_join(
        F.transform(X.words_of(C("text")), X.matching_word), " ").alias("words"))


@query("x14_message_class", """
  SELECT script_id, CASE script_id % 5 WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'permanent' WHEN 3 THEN 'transient'
    ELSE CASE WHEN contains(t, 'policy') OR contains(t, 'violat') THEN 'permanent'
      WHEN contains(right(t, 250), 'failed') THEN 'transient' END END AS kind
  FROM (SELECT script_id, right(array_to_string(ws, ' '), 600) AS t FROM (SELECT doc_id AS script_id, """
       + T.sql_words("lower(text)") + """ AS ws FROM documents))""")
def message_class(spark, folder):
    tail = F.get(F.array(F.lit(""), F.lit(" Not enough  credits left. "), F.lit(" This may violate our Policy."),
                         F.lit(" Something went\nwrong."), F.lit("")), (C("script_id") % 5).cast("int"))
    return T.scripts(spark, folder).select("script_id", X.classify_message(
        F.concat(C("text"), tail)).alias("kind"))


@query("x15_wrap_instruction", f"""
  SELECT doc_id AS script_id, 'Generate exactly one ' || CASE WHEN doc_id % 3 = 0 THEN 8 ELSE doc_id % 3 + 4 END
    || '-second 16:9 video (one output only) using the attached image as the start frame. Use this prompt exactly as'
    || ' written, without rewriting it: ' || array_to_string({T.sql_words('text')}, ' ') AS prompt FROM documents""")
def wrap_instruction(spark, folder):
    seconds = F.when(C("script_id") % 3 != 0, C("script_id") % 3 + 4.5)
    return T.scripts(spark, folder).select("script_id", X.wrap_instruction(C("text"), seconds).alias("prompt"))


@query("x16_prompt_override", """
  SELECT script_id, scene_ix, CASE WHEN scene_ix % 4 = 1 THEN 'custom ' || scene_ix ELSE 'rendered ' || text END AS prompt
  FROM scn""", "scn")
def prompt_override(spark, folder):
    custom = (F.when(C("scene_ix") % 4 == 1, F.concat(F.lit("custom "), C("scene_ix").cast("string")))
              .when(C("scene_ix") % 4 == 2, F.lit("")))
    return T.scenes(spark, folder).select("script_id", "scene_ix", X.prompt_for(
        custom, F.concat(F.lit("rendered "), C("text"))).alias("prompt"))


_DP = """
  SELECT script_id, round(r.best[-1], 4) AS cost, r.cnt[-1] AS n_scenes FROM (
    SELECT script_id, list_reduce(list(u ORDER BY sent_ix), lambda a, x: {
        'w': list_append(a.w, a.w[-1] + x.w[1]), 'e': list_append(a.e, a.e[-1] + x.e[1]), 'c': list_append(a.c, a.c[-1] + x.c[1]),
        't': list_append(a.t, a.t[-1] + x.t[1]),
        'best': list_append(a.best, STEP.cost), 'cnt': list_append(a.cnt, a.cnt[-STEP.back] + 1)},
      {'w': [0], 'e': [0], 'c': [0], 't': [0], 'best': [0.0::DOUBLE], 'cnt': [0]}) AS r
    FROM (SELECT script_id, sent_ix, {'w': [w], 'e': [e], 'c': [c], 't': [t], 'best': [0.0::DOUBLE], 'cnt': [0]} AS u FROM cnt_units)
    GROUP BY script_id)"""
# the best cut for the last unit: every start whose scene is short enough, or the unit alone
_STEP = """list_min(list_transform(list_filter(list_transform(range(1, len(a.best) + 1), lambda k: {'k': k,
    'd': CASE WHEN a.w[-1] + x.w[1] - a.w[-k] = 0 THEN 0.0::DOUBLE ELSE round(((a.w[-1] + x.w[1] - a.w[-k]) / 2.5
      + (30 * (a.e[-1] + x.e[1] - a.e[-k]) + 12 * (a.c[-1] + x.c[1] - a.c[-k])) / 100)::DOUBLE, 2) END,
    'b': a.best[-k], 't': a.t[-1] + x.t[1] - CASE WHEN k = 1 THEN a.t[-1] + x.t[1] ELSE a.t[-(k - 1)] END}),
    lambda s: s.d <= 8.5 OR s.k = 1), lambda s: {'cost': s.b + (2.0 + (7.0 - s.d) * (7.0 - s.d)
      + CASE WHEN s.d < 2.5 THEN 3.0 * (2.5 - s.d) * (2.5 - s.d) ELSE 0.0 END + 120.0 * s.t), 'back': s.k}))"""
block("cnt_units", """
  SELECT script_id, sent_ix, len(regexp_extract_all(text, '[A-Za-z0-9À-ɏ'']+'))::INT AS w,
    len(regexp_extract_all(text, '[.!?]+'))::INT AS e, len(regexp_extract_all(text, '[,;:—]'))::INT AS c,
    CASE WHEN paragraph <> lag(paragraph) OVER (PARTITION BY script_id ORDER BY sent_ix) THEN 1 ELSE 0 END AS t
  FROM c_sents""", "c_sents")


def scene_costs(rows, rule=P.Planning()):
    """Cost of each script's grouping, from its scenes."""
    def price(g):
        def total(name):
            return F.aggregate(g, F.lit(0), lambda a, u: a + u[name])

        d = X.speech_seconds(total("words"), total("ends"), total("clauses"), rule.words_per_second)
        turns = F.size(F.array_distinct(F.transform(g, lambda u: u["paragraph"]))) - 1
        return X.bound(d, lambda x: F.lit(rule.scene_cost) + (rule.target_s - x) * (rule.target_s - x)
                       + F.when(x < rule.min_s, P.SHORT_PENALTY * (rule.min_s - x) * (rule.min_s - x)).otherwise(0.0)
                       + F.lit(rule.paragraph_penalty) * turns)

    return F.aggregate(F.transform("scenes", price), F.lit(0.0), lambda a, c: a + c)


@query("k1_scene_grouping", _DP.replace("STEP", _STEP), "cnt_units")
def scene_grouping(spark, folder):
    units = F.flatten(F.transform(X.split_paragraphs(C("text")), lambda p, k: F.transform(
        F.transform(X.split_sentences(p), X.counted), lambda u: F.struct(
            k.cast("int").alias("paragraph"), u["text"].alias("text"), u["words"].alias("words"),
            u["ends"].alias("ends"), u["clauses"].alias("clauses")))))
    rows = SC.group_units(_dialogues(spark, folder).select("script_id", units.alias("units")))
    return rows.select("script_id", F.round(scene_costs(rows), 4).alias("cost"),
                       F.size("scenes").alias("n_scenes"))


@query("k2_scene_plan", """
  SELECT doc_id AS script_id, len(regexp_extract_all(text, '[A-Za-z0-9À-ɏ'']+')) AS words, 'welcome' AS first_gesture,
    0 AS repeats, true AS numbered FROM documents WHERE doc_id IN (SELECT script_id FROM sents)""", "sents")
def scene_plan(spark, folder):
    plan = SC.plan_scenes(T.scripts(spark, folder), template=F.lit(TEMPLATE), patterns=CORPUS_PATTERNS)
    from cuegrid.operators.scan import scan
    from cuegrid.session import stored

    plan = stored(plan.select("script_id", "scene_ix", "scene_id", "text", "gesture"))  # the scan reads its input twice
    seen = scan(plan, ["script_id"], ["scene_ix"], F.floor(C("scene_ix") / 16), number="rn",
                lags={"before": C("gesture")})
    return seen.groupBy("script_id").agg(
        F.sum(count_words(C("text"))).alias("words"),
        F.min_by("gesture", "scene_ix").alias("first_gesture"),
        F.count_if(C("gesture") == C("before")).alias("repeats"),
        F.bool_and(F.col("scene_id") == F.format_string("scene_%03d", "rn")).alias("numbered"))


@query("w1_scene_numbers", """
  SELECT script_id, 'scene_' || CASE WHEN scene_ix < 999 THEN lpad((scene_ix + 1)::VARCHAR, 3, '0')
    ELSE (scene_ix + 1)::VARCHAR END AS scene_id, text FROM scn""", "scn")
def scene_numbers(spark, folder):
    return T.scenes(spark, folder).select(
        "script_id", F.format_string("scene_%03d", C("scene_ix") + 1).alias("scene_id"), "text")


@query("j9_lines_in_texts", f"""
  SELECT b.item_id, d.doc_id FROM (SELECT item_id, lower(array_to_string({T.sql_words("translate(text, '\"“”’', '''''''''')")}, ' ')) AS l
    FROM benchmark) b JOIN (SELECT doc_id, lower(array_to_string({T.sql_words("translate(text, '\"“”’', '''''''''')")}, ' ')) AS t
    FROM documents) d ON contains(d.t, b.l) WHERE l <> ''""")
def lines_in_texts(spark, folder):
    from cuegrid.operators.matching import containing_texts

    lines = T.table(spark, folder, "benchmark").select("item_id", C("text").alias("line"))
    texts = T.spread(T.table(spark, folder, "documents").select("doc_id", "text"))
    return containing_texts(lines, texts, "item_id", "doc_id")


@query("i6_request_reuse", f"""
  SELECT item_id, CASE WHEN done IS NOT NULL THEN 'reuse' WHEN any_id IS NOT NULL THEN 'wait' ELSE 'new' END AS action,
    coalesce(done, any_id) AS request_id FROM (
    SELECT b.item_id, max(doc_id) FILTER (doc_id % 2 = 0) AS done, max(doc_id) AS any_id
    FROM (SELECT item_id, lower(array_to_string({T.sql_words("translate(text, '\"“”’', '''''''''')")}, ' ')) AS l FROM benchmark) b
    LEFT JOIN (SELECT doc_id, lower(array_to_string({T.sql_words("translate(text, '\"“”’', '''''''''')")}, ' ')) AS t
      FROM documents) d ON contains(d.t, b.l) GROUP BY ALL)""")
def request_reuse(spark, folder):
    from cuegrid.operators.matching import reuse_requests

    lines = T.table(spark, folder, "benchmark").select("item_id", C("text").alias("line"))
    requests = T.spread(T.table(spark, folder, "documents").select(
        C("doc_id").alias("request_id"), "text",
        F.when(C("doc_id") % 2 == 0, "finished").otherwise("pending").alias("state")))
    return reuse_requests(lines, requests, "item_id")


@query("production_plan")
def production_plan(spark, folder):
    from cuegrid.plans.corpus import production_plan as plan

    return plan(T.scripts(spark, folder))


@query("production_scenes", """
  SELECT script_id, sum(len(regexp_extract_all(text, '[A-Za-z0-9À-ɏ'']+')))::BIGINT AS words, true AS covered FROM sents
  GROUP BY script_id""", "sents")
def production_scenes(spark, folder):
    """Scenes hold every word once, and planned footage covers its narration within the
    slow-down bound."""
    from cuegrid.plans.corpus import scene_table

    rows = scene_table(T.scripts(spark, folder))
    enough = C("clip_durations").isNull() | (C("sync.ratio") >= 0.9 * 0.98)
    return rows.groupBy("script_id").agg(F.sum(count_words(C("text"))).alias("words"),
                                         F.bool_and(enough).alias("covered"))
