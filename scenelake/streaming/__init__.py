"""The batch operators over streams: event-time windows where they fit, keyed state where they do not."""
