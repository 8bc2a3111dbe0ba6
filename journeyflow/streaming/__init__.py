"""Structured Streaming operators."""

from journeyflow.streaming.sessions import journey_sessions, stream_journeys  # noqa: F401
