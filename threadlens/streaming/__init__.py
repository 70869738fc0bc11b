"""Streaming form of the user-engagement count.

The reference has no streaming layer (all input is a complete file). The only
piece offered here is the existing comments-per-(user, conversation)
aggregate (A5) run over a folder that keeps receiving comment-history files.
Its state lives in Spark's state store under the query's checkpoint location,
so a restarted or relocated query resumes from there.
"""

from threadlens.streaming.counts import start_user_conversation_counts, user_conversation_counts_stream

__all__ = ["start_user_conversation_counts", "user_conversation_counts_stream"]
