"""The query catalogue and its SQL counterparts."""
