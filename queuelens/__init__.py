"""Operations analytics on Spark: the data work of a task-queue platform."""
