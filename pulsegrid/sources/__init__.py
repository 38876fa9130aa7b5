"""Reading series and metadata, and writing results."""
