from panelstats.session import shared_dir
from panelstats.sources.io import write_table
from panelstats.streaming import read_answer_stream, scored_answers
from tests.fixtures import answers_frame


def test_scoring_runs_on_a_stream(spark):
    src = shared_dir(spark, "answers_in")
    batch = answers_frame(spark).limit(300)
    write_table(batch, src, fmt="csv")
    stream = scored_answers(read_answer_stream(spark, src))
    q = (stream.writeStream.format("memory").queryName("scored_answers_test")
         .option("checkpointLocation", shared_dir(spark, "answers_ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT count(*), count(ValidatedScore) FROM scored_answers_test").first()
    expected = scored_answers(batch).count()
    assert got[0] == expected
