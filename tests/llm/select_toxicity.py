"""python tests/llm/select_toxicity.py FOLDER: compares settings of the toxicity scores by folds within the learning rows.

Rows whose crc32(doc_id) mod 5 is 0 are held out from everything here, labels included. Of the others, those with remainder 1 and 2 in turn are left out of
learning and scored. Prints, for each setting, how many toxic ones of them are found and how many clean ones are flagged.
"""

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT

from pyspark.sql import functions as F  # noqa: E402

from quarry.llm import toxicity  # noqa: E402
from quarry.session import session  # noqa: E402

SETTINGS = {"POWER": (1, 2, 4)}


def main(folder: str, cpus: str = "2") -> None:
    spark = session(f"local[{cpus}]", "select", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(part != 0)
    for power in SETTINGS["POWER"]:
        toxicity.POWER = power
        found = {}
        for left_out in (1, 2):
            model = toxicity.fit(docs, labels.where(part != left_out))
            asked = docs.join(labels.where(part == left_out).select("doc_id", "toxic"), "doc_id")
            rows = toxicity.scored(asked.drop("toxic"), model).join(asked.select("doc_id", "toxic"), "doc_id")
            for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("flagged")).collect():
                old = found.get(r.toxic, (0, 0))
                found[r.toxic] = (old[0] + r.flagged, old[1] + r.n)
        print(f"POWER {power}: toxic found {found.get(1)}, clean flagged {found.get(0)}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
