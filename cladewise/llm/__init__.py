"""Operators of a training-data pipeline: each module holds one operator with its query and, where SQL can say it, its SQL."""
