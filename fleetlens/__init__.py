"""Operations analytics over snapshots of clusters, storage, workflows and SQL logs, on Spark."""
