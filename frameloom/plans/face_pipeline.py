"""The whole run over a detections table with embeddings: samples, clusters, people, best shots, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators import gates, identity, people
from frameloom.operators.identity import Rules


def clustered(samples: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """samples with cluster_id and member_pos; samples of nobody go. The fold's result (ids only) is kept for its many readers."""
    return samples.join(identity.cluster_faces(samples, rules).persist(), ["video_id", "seq"])


def run(detections: DataFrame, rules: Rules = Rules()) -> dict[str, DataFrame]:
    """samples, members, people, best and summary. Only members passes through Python, one group for each video."""
    samples = gates.face_samples(detections)
    members = people.numbered(clustered(samples, rules))
    found = people.people(members)
    return {"samples": samples, "members": members, "people": found, "best": people.best_shots(members, ["video_id", "person_id"]), "summary": people.summary(found, samples)}
