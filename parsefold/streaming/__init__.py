"""The playback state machine, in batch and as a stream."""
