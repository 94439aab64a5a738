"""leafmill.sinks"""
