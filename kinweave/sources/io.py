"""Tables from and to files, and known data sets of record linkage in the layout in which they are published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.model import Linkage

#: The columns of the published data sets.
RLDATA = "record_id long, label_true long, fname_c1 string, fname_c2 string, lname_c1 string, lname_c2 string, `by` long, bm long, bd long"
FEBRL = "record_id string, label_true string, given_name string, surname string, street_number string, address_1 string, address_2 string, suburb string, postcode string, state string, soc_sec_id int, date_of_birth string"
PATENTS = "record_id long, label_true long, name_true string, name string, latitude double, longitude double, coauthors string, classes string"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def links_from_labels(records: DataFrame) -> DataFrame:
    """Pairs of different records with one label, smaller id left."""
    a = records.select(F.col("record_id").alias("record_id_l"), "label_true")
    b = records.select(F.col("record_id").alias("record_id_r"), "label_true")
    return a.join(b, "label_true").where("record_id_l < record_id_r").select("record_id_l", "record_id_r")


def labelled(records: DataFrame) -> Linkage:
    return Linkage(records, records, links_from_labels(records))


def load_rldata(spark: SparkSession, path: str) -> Linkage:
    """The R package's persons with duplicates (500 or 10,000 records), from a CSV file."""
    return labelled(read_csv(spark, path, RLDATA))


def load_febrl(spark: SparkSession, path: str) -> Linkage:
    """One of the FEBRL sets, from a CSV file."""
    return labelled(read_csv(spark, path, FEBRL))


def load_patents(spark: SparkSession, path: str) -> Linkage:
    """A sample of patent applicants, from a CSV file."""
    return labelled(read_csv(spark, path, PATENTS))
