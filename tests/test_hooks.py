"""Hook operators and the transcript source on small literal tables."""

from pyspark.sql import functions as F

from trailmark.operators import hooks
from trailmark.sources import transcripts


def one(spark, value, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(value).first()[0]


def test_previews(spark):
    def shown(tool, tool_input, content):
        return one(spark, hooks.preview(F.col("t"), F.col("i"), F.col("c").cast("string")), t=tool, i=tool_input, c=content)

    assert shown("Edit", '{"old_string":"a","new_string":"b"}', "aXa") == "bXa"
    assert shown("Edit", '{"old_string":"a","new_string":"b","replace_all":true}', "aXa") == "bXb"
    assert shown("Edit", '{"old_string":"q","new_string":"b"}', "aXa") == "b"  # no edit fits: the written text
    assert shown("Edit", '{"old_string":"","new_string":"b"}', "aXa") == "b"
    assert shown("Edit", '{"old_string":"a","new_string":"b"}', None) == "b"
    many = '{"edits":[{"old_string":"a","new_string":"b"},{"old_string":"b","new_string":"c","replace_all":true}]}'
    assert shown("MultiEdit", many, "abb") == "ccc"  # later edits see the earlier ones
    assert shown("MultiEdit", many, "x") == "b\nc\n"
    assert shown("Write", '{"content":"new"}', "old") == "new" and shown("Read", "{}", "old") == ""


def test_line_ranges(spark):
    def shown(text, ranges):
        return one(spark, hooks.line_ranges(F.col("x"), F.col("r")), x=text, r=ranges)

    text = "a\nb\r\nc\n"
    assert shown(text, "1-2,3") == "   1| a\n   2| b\n   3| c"
    assert shown(text, "-1") == "   1| a" and shown(text, "2-") == "   2| b\n   3| c"
    assert shown(text, "3, 1") == "   3| c\n   1| a"
    assert shown(text, "0") == shown(text, "9") == shown(text, "3-2") == shown("", "1-5") == "No lines matched the range."


def test_transcript_files(spark, tmp_path):
    lines = [
        '{"type":"user"}',
        '{"type":"assistant","message":{"model":"old","usage":{"input_tokens":100}}}',
        '{"type":"user"}',
        '{"type":"assistant","message":{"model":"m","stop_reason":"tool","usage":{"input_tokens":5,"output_tokens":2,"cache_read_input_tokens":7}}}',
        "broken",
        '{"type":"assistant","message":{"usage":{"input_tokens":1,"cache_creation_input_tokens":3}}}',
        '{"type":"assistant","message":{"stop_reason":"end"}}',
        '{"type":"user"}',
    ]
    (tmp_path / "one.jsonl").write_text("\n".join(lines))
    (tmp_path / "none.jsonl").write_text('{"type":"user"}\n')
    found = [r.asDict() for r in transcripts.last_usage(transcripts.read(spark, str(tmp_path))).collect()]
    assert len(found) == 1 and found[0].pop("id").endswith("one.jsonl")
    assert found[0] == {"input_tokens": 6, "output_tokens": 2, "cache_read_tokens": 7, "cache_creation_tokens": 3, "model": "m", "stop_reason": "end"}


def test_captures_must_be_shorter(spark):
    def sent(output, original, compressed, code):
        return one(spark, hooks.replacement(F.col("o"), F.lit(original), F.lit(compressed), F.col("c")), o=output, c=code)

    assert sent("two words", 100, 10, 1).output == "[trailmark: compressed Bash output, exit 1; 100->10 tokens]\ntwo words\n[exit: 1]"
    assert sent("two words", 12, 10, 0) is None and sent(" ", 100, 1, 0) is None and sent("two words", 100, 100, 0) is None


def test_rows_are_appended(spark):
    spark.sql("drop table if exists appended_rows")
    for _ in range(2):
        hooks.append(hooks.tool_call_rows(spark.sql("select 1L as request_id, array(named_struct('id', 'c', 'name', 'Read', 'input', '{}')) as tool_calls")), "appended_rows")
    assert [tuple(r) for r in spark.table("appended_rows").collect()] == [(1, "c", "Read", "{}")] * 2
    spark.sql("drop table appended_rows")
