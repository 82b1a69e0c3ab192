"""docsift.functions"""
