"""Relational operators over learner events, annotation logs, exam banks and timed annotations."""
