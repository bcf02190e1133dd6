"""Corpus operators for training-data pipelines; nothing else imports this."""

import os

# Spark runs a task on each core; a BLAS of many threads in each would fight over them.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")
