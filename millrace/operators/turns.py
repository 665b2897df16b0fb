"""Conversations: actions of turns, repetition, gates over a whole conversation, renderers, messages.

The driver's conversations hold plain prose, so `TURNS` puts commands, marks and flags into them, in SQL
that both engines read alike; the operators are the Column builders of `functions.turns` and
`functions.names`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.functions import observations as O
from millrace.functions import turns as T
from millrace.plans.registry import query
from millrace.session import table, views

MARKER = "DONE_MARK"
TURNS = """
SELECT conv_id, turn, role, turn % 3 <> 0 AS score_target, turn % 7 = 0 AS submit_accepted, role = 'user' AND turn % 4 = 2 AS injected, role = 'user' AND turn % 8 = 6 AS nudge, role = 'user' AND turn % 4 = 0 AS environment_observation,
CASE WHEN role = 'assistant' AND conv_id % 4 = 0 THEN 'THOUGHT: The same plan as before, long enough to count as one.' || chr(10) || '```bash' || chr(10) || 'cat src/a.py' || chr(10) || '```'
  WHEN role = 'assistant' AND conv_id % 4 = 1 AND turn > 2 THEN 'Submit.' || chr(10) || '```bash' || chr(10) || 'echo DONE_MARK' || chr(10) || '```'
  WHEN role = 'assistant' AND (conv_id + turn) % 6 = 0 THEN '</think>' || text
  WHEN role = 'assistant' AND (conv_id + turn) % 6 = 1 THEN 'THOUGHT: Fix it.' || chr(10) || '```bash' || chr(10) || 'sed -i ' || chr(39) || 's/a/b/' || chr(39) || ' pkg/mod.py lib/other.py' || chr(10) || '```'
  WHEN role = 'assistant' AND (conv_id + turn) % 6 = 2 THEN '```bash' || chr(10) || 'ls  -la' || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```sh' || chr(10) || 'pwd' || chr(10) || '```'
  WHEN role = 'assistant' AND (conv_id + turn) % 6 = 3 THEN 'Look. <mswea_bash_command>grep -n run_it() src/b.py</mswea_bash_command>'
  WHEN role = 'assistant' AND (conv_id + turn) % 6 = 4 THEN text || ' <|im_end|>'
  WHEN role <> 'assistant' AND turn % 4 = 0 THEN 'I read pkg/mod.py and `run_it` there.' ELSE text END AS content
FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL"""

_T = f"WITH t AS ({TURNS})"
_TRIM = r"regexp_replace({0}, '^\s+|\s+\z', '', 'g')"
_BLOCKS = r"list_transform(list_concat(regexp_extract_all(content, '(?is)```(?:bash|sh|shell)[ \t]*\n(.*?)```', 1), regexp_extract_all(content, '(?is)<mswea_bash_command>(.*?)</mswea_bash_command>', 1)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+\z', '', 'g'), '\s+', ' ', 'g'))"
_GATES = f"""
{_T},
b AS (SELECT *, {_BLOCKS} AS blocks FROM t),
a AS (SELECT *, CASE WHEN len(blocks) = 1 THEN blocks[1] END AS cmd, contains(content, 'THOUGHT: The same plan') AS long_, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM b WHERE role = 'assistant'),
"""


def turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "conversations")
    return spark.sql(TURNS)


def whole(rows: DataFrame) -> DataFrame:
    """One row for each conversation, its turns as an array in order."""
    fields = F.struct("turn", "role", "content", "score_target", "submit_accepted", "injected", "nudge", "environment_observation")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(fields)).alias("turns"))


@query(rf"""
{_T}
SELECT conv_id, turn, len({_BLOCKS}) AS n_blocks, CASE WHEN contains(content, '```bash') THEN {_TRIM.format("regexp_extract(content, '(?s)```bash[ \t]*\n(.*?)```', 1)")} WHEN contains(content, '<mswea') THEN 'grep -n run_it() src/b.py' END AS script,
  nullif(regexp_extract(content, '<\|im_end\|>'), '') AS reserved,
  CASE WHEN {_TRIM.format('content')} = '' THEN 'empty response' WHEN len({_BLOCKS}) = 0 THEN 'no bash command found in the response' WHEN len({_BLOCKS}) > 1 THEN 'found ' || len({_BLOCKS}) || ' bash commands in the response, expected exactly one' END AS unusable,
  md5(regexp_replace({_TRIM.format("regexp_replace(regexp_replace(content, '(?s)```bash.*', ''), '(?s)<mswea.*|^</think>', '')")}, '^THOUGHT:\s*', '')) AS thought,
  CASE WHEN contains(content, 'sed -i') THEN 'pkg/mod.py,lib/other.py' ELSE '' END AS inplace, contains(content, 'sed -i') AS edited, contains(content, 'sed -i') AS work FROM t""")
def turn_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS13, FS14, FS15, FS32, FS47, RP05, TQ10: what each turn runs, says, edits, and why it may be unusable."""
    c = F.col("content")
    return turn_rows(spark, sf_dir).select(
        "conv_id", "turn", F.size(O.action_blocks(c)).cast("bigint").alias("n_blocks"), O.first_script(c).alias("script"), O.reserved_token(c).alias("reserved"), O.unusable_turn(c).alias("unusable"),
        F.md5(T.thought(c)).alias("thought"), F.array_join(T.inplace_paths(c), ",").alias("inplace"), T.edited_in_turn(c).alias("edited"), T.shows_work(c).alias("work"),
    )


@query(f"""
{_GATES}
r AS (SELECT conv_id, min(back) FILTER (cmd IS NULL OR cmd <> f OR f IS NULL) AS stop_c, min(back) FILTER (NOT long_) AS stop_t, count(*) AS n FROM (SELECT *, first_value(cmd) OVER (PARTITION BY conv_id ORDER BY back) AS f FROM a) x GROUP BY 1),
c AS (SELECT DISTINCT conv_id FROM t)
SELECT conv_id, CAST(coalesce(stop_c - 1, n, 0) AS int) AS repeats, CAST(coalesce(stop_t - 1, n, 0) AS int) AS thoughts FROM c LEFT JOIN r USING (conv_id)""")
def trailing_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY RP01, RP02: how long the last command and the last thought have been the same."""
    m = F.col("turns")
    return whole(turn_rows(spark, sf_dir)).select("conv_id", T.trailing_repeats(m).alias("repeats"), T.trailing_thoughts(m).alias("thoughts"))


@query(f"""
{_GATES}
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS sback, NOT submit_accepted AND contains(content, 'echo DONE_MARK') AS wrong FROM a WHERE score_target),
g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (content LIKE '</think>%') AS think, count(*) FILTER (contains(content, '<|im_end|>')) AS marks, min(sback) FILTER (NOT wrong) AS stop FROM s GROUP BY 1),
p AS (SELECT conv_id, max(CAST(contains(content, 'sed -i') AS int)) AS edits, count(*) AS mine FROM a GROUP BY 1),
u AS (SELECT e.conv_id, string_agg(path, ',' ORDER BY e.turn, k) AS unread FROM (SELECT conv_id, turn, unnest(['pkg/mod.py', 'lib/other.py']) AS path, unnest([1, 2]) AS k FROM s WHERE contains(content, 'sed -i')) e
  WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.conv_id = e.conv_id AND o.turn < e.turn AND contains(o.content, split_part(path, '/', 2))) GROUP BY 1)
SELECT conv_id, 2 * coalesce(think, 0) > coalesce(n, 0) AS amputated, CASE WHEN marks > 0 THEN '<|im_end|>' END AS malformed, CASE WHEN coalesce(stop - 1, n, 0) >= 2 THEN CAST(coalesce(stop - 1, n) AS int) END AS loop_,
  coalesce(unread, '') AS unread, CASE WHEN edits = 1 THEN 'at_edit' WHEN coalesce(mine, 0) <= 2 THEN 'cold' ELSE 'pre_edit' END AS phase FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN g USING (conv_id) LEFT JOIN p USING (conv_id) LEFT JOIN u USING (conv_id)""")
def conversation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY TQ11, TQ16, TQ19, XA21, FM14: amputated thinking, edits of unread files, reserved tokens, submission loops (two or more here), phase."""
    m = F.col("turns")
    return whole(turn_rows(spark, sf_dir)).select(
        "conv_id", T.amputated(m).alias("amputated"), T.malformed(m).alias("malformed"), T.submission_loop(m, MARKER, 2).alias("loop_"),
        F.array_join(T.unread_edits(m), ",").alias("unread"), T.sample_phase(m).alias("phase"),
    )


@query()
def empty_submit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY TQ17: submits without work since the one before; tests hold it against a plain loop."""
    return whole(turn_rows(spark, sf_dir)).select("conv_id", T.empty_submits(F.col("turns"), MARKER).alias("empty"))


@query(f"""
{_GATES}
o AS (SELECT *, CASE (conv_id + turn) % 3 WHEN 0 THEN '' WHEN 1 THEN cmd ELSE 'some output' END AS observation, lag(blocks) OVER w AS pb, lag((conv_id + turn) % 3) OVER w AS pk, lag(cmd) OVER w AS pc FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CAST(sum(CASE WHEN len(blocks) > 0 AND blocks = pb AND (pk = 0 AND NOT regexp_matches(coalesce(pc, ''), '^sed\\s+-i') OR pk = 1 AND pc IS NOT NULL) THEN 0 ELSE len(blocks) END) AS bigint) AS counted FROM o GROUP BY 1""")
def counted_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY TQ13, XA19: commands of a conversation, repeated ones after an unanswered observation left out."""
    kind = (F.col("conv_id") + F.col("turn")) % 3
    seen = F.when(kind == 0, "").when(kind == 1, T.single_command(F.col("content"))).otherwise("some output")
    rows = turn_rows(spark, sf_dir).where("role = 'assistant'").withColumn("observation", seen)
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "content", "observation"))).alias("turns"))
    return own.select("conv_id", F.size(T.counted_commands(F.col("turns"))).cast("bigint").alias("counted"))


@query(f"""
{_T},
n AS (SELECT *, count(*) FILTER (role = 'assistant' AND score_target) OVER (PARTITION BY conv_id ORDER BY turn) AS nth, count(*) FILTER (role = 'assistant' AND score_target) OVER (PARTITION BY conv_id) AS n FROM t),
d AS (SELECT conv_id, 'FULL CANDIDATE TRAJECTORY' || chr(10) || 'Score ONLY ' || CASE max(n) WHEN 1 THEN 'CANDIDATE OUTPUT' ELSE 'CANDIDATE OUTPUT 1 through CANDIDATE OUTPUT ' || max(n) END || '. The ENVIRONMENT OBSERVATION is context only.' || chr(10) ||
  string_agg(chr(10) || CASE WHEN role = 'assistant' AND score_target THEN 'CANDIDATE OUTPUT ' || nth WHEN role = 'user' AND environment_observation THEN 'ENVIRONMENT OBSERVATION (context only, do not score)' ELSE 'CONTEXT ' || upper(role) || ' (do not score)' END || ':' || chr(10) || '------' || chr(10) || regexp_replace(content, '\\s+\\z', '') || chr(10) || '------', chr(10) ORDER BY turn) AS doc,
  coalesce(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) ORDER BY turn) FILTER (content <> '') || chr(10), '') || '<|im_start|>assistant' || chr(10) AS chat FROM n GROUP BY 1)
SELECT conv_id, md5(doc) AS document, md5(chat) AS chat FROM d""")
def rendered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS37, FS38: each conversation as a judged document and in chat form."""
    return whole(turn_rows(spark, sf_dir)).select("conv_id", F.md5(T.scored_document(F.col("turns"))).alias("document"), F.md5(T.chat_text(F.col("turns"))).alias("chat"))


@query(rf"""
SELECT doc_id, md5({_TRIM.format('text')}) AS user_text, 2 AS n_turns, md5(CASE WHEN {_TRIM.format('text')} = '' THEN 'a' || chr(10) || chr(10) || 'b' ELSE {_TRIM.format('text')} || chr(10) || chr(10) || 'b' END) AS first_turn, CASE doc_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'system' ELSE 'user' END AS role
FROM documents WHERE text IS NOT NULL AND {_TRIM.format('text')} <> ''""")
def parsed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS39, FS40, FS41: system and user of a chat text, turns of a rendered trajectory, role names."""
    own = table(spark, sf_dir, "documents").where(F.regexp_replace("text", r"^\s+|\s+\z", "") != "")
    chat = F.concat(F.lit("<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\n"), "text", F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    told = F.concat(F.lit("REFERENCE STEP 1:\n"), "text", F.lit("\nREFERENCE STEP 2:\nb\nENVIRONMENT OBSERVATION:\nc"))
    role = F.get(F.array(*map(F.lit, ("human", "gpt", "system", "tool"))), (F.col("doc_id") % 4).cast("int"))
    turns = T.trajectory_turns(told)
    return own.select("doc_id", F.md5(T.system_and_user(chat)["user"]).alias("user_text"), F.size(turns).alias("n_turns"), F.md5(turns[0]["content"]).alias("first_turn"), T.chat_role(role).alias("role"))


_MESSAGE = """
SELECT doc_id, text, CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'THOUGHT: ' || substring(text, 1, 50) WHEN 2 THEN 'As an AI I would look again.' WHEN 3 THEN 'Please add a test for that.' WHEN 4 THEN 'Look at pkg/none_such.py again.'
  WHEN 5 THEN 'What of `no_such_name` here?' WHEN 6 THEN 'again and again and again and again and again and again and again and again and again and again and again and again' ELSE 'Please go on with this.' END AS message FROM documents"""


@query(f"""
WITH m AS ({_MESSAGE})
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'agent' WHEN 2 THEN 'character' WHEN 3 THEN 'tests' WHEN 4 THEN 'files' WHEN 5 THEN 'symbols' WHEN 6 THEN 'repetition' END AS ungrounded, true AS same FROM m""")
def message_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS45, FS46: why a message doesn't belong in its session, and whether boilerplate changes a request."""
    views(spark, sf_dir, "documents")
    own, m = spark.sql(_MESSAGE), F.col("message")
    with_clause = F.concat(F.lit("  "), m, F.lit("\nSubmit the same way when done: echo X"))
    return own.select("doc_id", T.ungrounded(m, F.col("text")).alias("ungrounded"), T.same_request(m, with_clause).alias("same"))


@query(r"""
WITH p AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\n', ' ', 'g') || ' I found the cause of the failure in it. Let me now look at the other places too.' AS prose FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(prose, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+\z', '', 'g')), lambda x: length(x) > 25 AND NOT regexp_matches(x, '(?i)^(let me|now let me|now i|i need to|i''ll|i will|let''s|first,? let me|next,? let me|now,? let me)\b')) AS good FROM p)
SELECT doc_id, md5(array_to_string(good[-2:], '|')) AS prose, 'run_me,src/a.py' AS targets, doc_id % 2 = 0 AS agree FROM s""")
def approach_of_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS48, FS49, FS50: what a step's commands name, the findings it states, whether spans agree."""
    code = "```bash\ngrep -n run_me() src/a.py && printf x\n```\n"
    step = F.concat(F.lit(code), F.coalesce("text", F.lit("")), F.lit(" I found the cause of the failure in it. Let me now look at the other places too."))
    one, two = F.lit("def handler(request, response)"), F.when(F.col("doc_id") % 2 == 0, "def handler(request, reply)").otherwise("class Something(Base)")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.array_join(T.approach_prose(F.array(step)), "|")).alias("prose"), F.array_join(F.array_sort(T.command_targets(step)), ",").alias("targets"), T.spans_agree(F.array(one, two), 0.5).alias("agree"),
    )


@query(r"""
WITH n AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3999 = 0 THEN NULL ELSE CAST(p_partkey % 3999 AS int) END AS k FROM part),
r AS (SELECT *, ['','M','MM','MMM'][k // 1000 + 1] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][k % 1000 // 100 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][k % 100 // 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][k % 10 + 1] AS roman FROM n)
SELECT p_partkey, trim(lower(regexp_replace(regexp_replace('Own.Er/' || p_name || ' v1', '^[^/]*/', ''), '\W+', '_', 'g')), '_') AS sane, roman, k AS back, 'Own.Er' AS family, 'own/' || p_partkey AS repo, 'bkt' AS bucket, 'k/' || p_partkey AS key,
  p_partkey % 2 = 0 AS scratch, CAST(p_partkey % 3 AS int) AS code, CASE p_partkey % 3 WHEN 0 THEN 'editor' WHEN 1 THEN 'other' END AS client FROM r""")
def names_and_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS10, FS34, FS35, FS36, XA23, XA45, XA47: names of models, numerals, addresses, scratch paths, clients, status lines."""
    p = F.col("p_partkey")
    k = F.nullif(p % 3999, F.lit(0)).cast("int")
    model = F.concat(F.lit("Own.Er/"), "p_name", F.lit(" v1"))
    uri = F.concat(F.lit("s3://bkt/k/"), p.cast("string"))
    path = F.when(p % 2 == 0, F.concat(F.lit("./repro_"), p.cast("string"), F.lit(".py"))).otherwise(F.lit("src/test/mod.py"))
    agent = F.when(p % 3 == 0, "My-Editor/1.0").when(p % 3 == 1, "curl/8").otherwise("")
    out = F.concat(F.lit("x\n__RC__"), (p % 3).cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", N.sanitized(model).alias("sane"), N.roman(k).alias("roman"), N.from_roman(N.roman(k)).alias("back"), N.judge_family(model).alias("family"),
        N.repository(F.concat(F.lit("hub://hub.example.com/own/"), p.cast("string"), F.lit("@sha256:ab"))).alias("repo"), N.bucket_and_key(uri)["bucket"].alias("bucket"), N.bucket_and_key(uri)["key"].alias("key"),
        T.is_scratch(path).alias("scratch"), T.split_status(out)["code"].alias("code"), T.client_family(agent, {"editor": "editor"}).alias("client"),
    )
