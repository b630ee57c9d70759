"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from corpusqa.plans import all_queries
from corpusqa.session import local_session

HEADLINES = (
    "word_count",
    "word_frequency",
    "cooc_adjacent",
    "cooc_sentence",
    "corpus_profile",
    "split_snippets",
    "build_index",
    "find_terms",
    "link_entities",
    "paragraph_vector",
    "nearest_neighbors_all",
    "candidates_vectors",
    "extract_passages",
    "ask_batch",
    "merge_process",
    "get_corpus",
    "train_embeddings",
    "find_terms_bm25",
    "corpus_stats_run",
    "near_words_text",
    "rank_metadata",
    "ask_stream",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str, folder: str) -> float:
        at = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - at

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    seconds = {}
    for name in HEADLINES:
        run(name, small if os.path.isdir(small) else sf_dir)  # code is compiled, workers are up
        seconds[name] = round(statistics.median(run(name, sf_dir) for _ in range(RUNS)), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
